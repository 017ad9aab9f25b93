"""Keyword suggestion: n-gram TF-IDF with name evidence, cohesion and subsumption."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import spread, stored

# Limits, and words that may stand inside a gram but not end it.
PARTICLES = frozenset("de del da di du la las le les los el van von der den bin ibn al af av dos das".split())
LINKERS = PARTICLES | {"of", "the"}
NAME_RATIO, DF_CEILING, MAX_WORDS, CAP, SUBSUME = 0.95, 0.35, 4, 30, 0.4


@dataclass(frozen=True)
class LanguagePack:
    """Word frequencies (Zipf scale) and function words of a language; empty gates let every term pass."""

    zipf: dict[str, float] = field(default_factory=dict)
    function_words: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()


_piece = regex.compile(r"[\p{L}][\p{L}'’-]*|[.!?…;\n]|[\"“”‘’(\[{*_:—–«»]")


def word_runs(text: str | None) -> list[tuple[str, str, bool]]:
    """(word in lower case, as written, whether it opens a sentence) in order; '.' stands for the end of a run."""
    out, opens = [], True
    for w in _piece.findall(text or ""):
        if w in ".!?…;\n":
            out.append((".", w, True))
            opens = True
        elif not w[0].isalpha():
            opens = True
        else:
            core = w.strip("'’-")
            owned = bool(re.search(r"['’]s$", core, re.I))
            core = core[:-2] if owned else core
            if owned:
                out.append((".", "", opens))
            if core:
                out.append((core.lower(), core, opens))
            if owned:
                out.append((".", "", False))
            opens = False
    return out


def grams(words: list[str], blocked: Callable[[str], bool], most: int = MAX_WORDS) -> Iterator[tuple[str, str]]:
    """(gram, next word) of every run of up to ``most`` content words; linkers may stand inside, particles may lead, neither ends one."""
    for i, first in enumerate(words):
        if blocked(first) and first not in PARTICLES:
            continue
        content = 0
        for j in range(i, len(words)):
            w = words[j]
            if w in LINKERS:
                continue
            if blocked(w):
                break
            content += 1
            if content > most:
                break
            yield " ".join(words[i : j + 1]), words[j + 1] if j + 1 < len(words) else "."


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each word by entry: occurrences, lower-case ones, capitals inside a sentence, all-capitals, other capitals."""
    for b in batches:
        rows = []
        for world, text in zip(b.column("world").to_pylist(), b.column("content").to_pylist()):
            n: dict[str, list[int]] = {}
            for low, core, opens in word_runs(text):
                if low == ".":
                    continue
                c = n.setdefault(low, [0] * 5)
                shout = len(core) > 1 and core.isupper()
                c[0] += 1
                c[1] += core[0].islower()
                c[2] += core[0].isupper() and not opens
                c[3] += shout
                c[4] += not shout
            rows += [(world, w, *c) for w, c in n.items()]
        cols = list(zip(*rows)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), *[pa.int64()] * 5])], names=["world", "word", "cf", "lower", "caps_mid", "shouted", "mixed"])


def word_evidence(entries: DataFrame) -> DataFrame:
    """(world, word, df, cf, lower, caps_mid, shouted, mixed, is_name): a word is a name if nearly all its uses inside sentences are
    capitalised, or if it is a short one only ever in capitals."""
    rows = spread(entries.select("world", "content")).mapInArrow(_evidence, "world string, word string, cf long, lower long, caps_mid long, shouted long, mixed long")
    sums = rows.groupBy("world", "word").agg(F.count(F.lit(1)).alias("df"), *[F.sum(c).alias(c) for c in ("cf", "lower", "caps_mid", "shouted", "mixed")])
    acronym = (F.length("word") <= 6) & (F.col("shouted") > 0) & (F.col("mixed") == 0)
    ratio = (F.col("caps_mid") > 0) & (F.col("caps_mid") / (F.col("caps_mid") + F.col("lower")) >= NAME_RATIO)
    return sums.withColumn("is_name", acronym | (ratio & (F.col("word") != "i")))


def _gram_rows(pack: LanguagePack, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for world, entry, text, stops in zip(*(b.column(c).to_pylist() for c in ("world", "entry_id", "content", "stops"))):
                words = [w for w, _, _ in word_runs(text)]
                stop = pack.function_words.union(stops or ()) | {"."}
                tf: Counter = Counter()
                follow: dict[str, set] = {}
                for g, nxt in grams(words, lambda w: len(w) < 2 or w in stop, most):
                    tf[g] += 1
                    follow.setdefault(g, set()).add(nxt)
                rows += [(world, entry, g, n, g.count(" ") + 1, sum(w not in LINKERS for w in g.split(" ")), next(iter(follow[g])) if len(follow[g]) == 1 else None) for g, n in tf.items()]
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["world", "entry_id", "gram", "tf", "words", "content_words", "next_word"])

    return run


def entry_grams(entries: DataFrame, pack: LanguagePack = LanguagePack(), most: int = MAX_WORDS) -> DataFrame:
    """(world, entry_id, gram, tf, words, content_words, next_word); words that behave as function words in their book are stops.

    The stops of a book are words in over 30 % of its entries, used little in each, that aren't names: a list bounded by the entry
    lengths, joined by book.
    """
    ev = word_evidence(entries)
    size = entries.groupBy("world").agg(F.count(F.lit(1)).alias("n"))
    stops = ev.join(size, "world").filter((F.col("df") / F.col("n") > 0.3) & (F.col("cf") / F.col("df") < 6) & ~F.col("is_name"))
    lists = stops.groupBy("world").agg(F.collect_list("word").alias("stops"))
    rows = entries.select("world", "entry_id", "content").join(lists, "world", "left")
    return rows.mapInArrow(_gram_rows(pack, most), "world string, entry_id long, gram string, tf int, words int, content_words int, next_word string")


def ngram_scores(entries: DataFrame, pack: LanguagePack = LanguagePack(), df_ceiling: float = DF_CEILING, most: int = MAX_WORDS) -> DataFrame:
    """(world, entry_id, gram, tf, df, words, score): tf x idf with longer grams favoured, grams in too many entries out."""
    g = stored(entry_grams(entries, pack, most), "entry-grams")
    df = g.groupBy("world", "gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.min("next_word").alias("n1"), F.max("next_word").alias("n2"), F.count("next_word").alias("nn"))
    size = entries.groupBy("world").agg(F.count(F.lit(1)).alias("n"))
    fixed = (F.col("words") > 1) & (F.col("cf") >= 2) & (F.col("n1") == F.col("n2")) & (F.col("nn") == F.col("df")) & (F.col("n1") != ".")  # always goes on the same way
    rows = g.join(df, ["world", "gram"]).join(size, "world").filter((F.col("df") / F.col("n") <= df_ceiling) & ~F.coalesce(fixed, F.lit(False)))
    score = F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 0.5)) * (1 + 0.5 * (F.col("content_words") - 1))
    return rows.filter(~T.is_date_like("gram")).select("world", "entry_id", "gram", "tf", "df", "words", score.alias("score"))


def cohesion(scores: DataFrame) -> DataFrame:
    """(world, gram, cohesion): entries with the gram over twice those with its better shoulder (first or last two words)."""
    df = scores.select("world", "gram", "words", "df").distinct()
    parts = F.split("gram", " ")
    shoulders = df.filter("words > 2").select("world", "gram", "df", F.explode(F.array(F.array_join(F.slice(parts, 1, 2), " "), F.array_join(F.slice(parts, -2, 2), " "))).alias("s"))
    best = shoulders.join(df.select("world", F.col("gram").alias("s"), F.col("df").alias("sdf")), ["world", "s"], "left").groupBy("world", "gram").agg(F.first("df").alias("df"), F.max("sdf").alias("best"))
    return best.select("world", "gram", F.coalesce(F.greatest("df", F.lit(1)) / (2 * F.col("best")), F.lit(1.0)).alias("cohesion"))


def suggestions(entries: DataFrame, pack: LanguagePack = LanguagePack(), cap: int = CAP, least: int = 2) -> DataFrame:
    """(world, entry_id, gram, tf, df, score, rank): the best new keys of each entry.

    A gram used once must be made of names. A long cohesive gram takes the place of the grams it contains at the same count; one that
    isn't gives way to its shoulder. Grams that an entry lists as keys already are left out.
    """
    rows = stored(ngram_scores(entries, pack), "grams")  # read for names, cohesion and subsumption
    names = word_evidence(entries).filter("is_name").select("world", "word")
    once = rows.filter(F.col("tf") < least)
    words = once.select("world", "entry_id", "gram", F.explode(F.split("gram", " ")).alias("word")).filter(~F.col("word").isin(sorted(LINKERS)))
    unnamed = words.join(names, ["world", "word"], "left_anti").select("world", "entry_id", "gram").distinct()
    rows = stored(rows.join(unnamed, ["world", "entry_id", "gram"], "left_anti"), "named-grams")
    held = rows.join(cohesion(rows), ["world", "gram"], "left").withColumn("cohesive", (F.coalesce("cohesion", F.lit(1.0)) >= SUBSUME) | (F.col("words") < 3))
    # what contains what is settled inside an entry, whose grams are bounded by its text
    one = held.groupBy("world", "entry_id").agg(F.collect_list(F.struct("gram", "tf", "df", "score", "words", "cohesive")).alias("grams"))
    have = entries.select("world", "entry_id", F.coalesce("key", F.array().cast("array<string>")).alias("keys"))
    schema = "world string, entry_id long, gram string, tf int, df long, score double, rank int"
    return one.join(have, ["world", "entry_id"]).select("world", "entry_id", "grams", "keys").mapInArrow(_kept_grams(cap), schema)


def lost_grams(rows: list[tuple[str, int, int, bool]]) -> set[str]:
    """Of an entry's grams (gram, tf, words, cohesive) those that give way: a gram inside a cohesive longer one of the same count, and a longer one that isn't cohesive before its shoulder."""
    at = {(g, tf): words for g, tf, words, _ in rows}
    lost = set()
    for gram, tf, words, cohesive in rows:
        parts = gram.split(" ")
        if words > 1:
            inner = {(i, j) for i in range(words) for j in range(i + 1, words + 1)} - {(0, words)}
            for i, j in inner:
                short = " ".join(parts[i:j])
                if (short, tf) in at and short != gram:
                    if cohesive and at[short, tf] > 1:
                        lost.add(short)
                    elif not cohesive and at[short, tf] == 2 and (i == 0 or j == words):
                        lost.add(gram)
    return lost


def _kept_grams(cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for world, entry, grams, keys in zip(*(b.column(c).to_pylist() for c in ("world", "entry_id", "grams", "keys"))):
                gone = lost_grams([(g["gram"], g["tf"], g["words"], g["cohesive"]) for g in grams]) | {k.lower().strip(" ") for k in keys if k}
                kept = sorted((g for g in grams if g["gram"] not in gone), key=lambda g: (-g["score"], g["gram"]))[:cap]
                out += [(world, entry, g["gram"], g["tf"], g["df"], g["score"], n) for n, g in enumerate(kept, 1)]
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["world", "entry_id", "gram", "tf", "df", "score", "rank"])

    return run


def parse_key_list(raw: str | None) -> list[str]:
    """Keys out of a model's free answer: one a line or comma, without numbering, quotes and ends, of at most six words."""
    lines = re.split(r"[\n,]+", (raw or "").translate(str.maketrans("‘’“”", "''\"\"")))
    out = [re.sub(r"[\"'`.;:]+$", "", re.sub(r"^[\s\-*•\d.)\]]+", "", x)).strip() for x in lines]
    return [x for x in out if x and len(x.split()) <= 6]


def form_vote(forms: DataFrame, by: list[str], form: str = "form") -> DataFrame:
    """The written form most used, one that isn't shouted first among equals."""
    shout = F.col(form).rlike(r"\p{Lu}{3,}").cast("int")
    counts = forms.groupBy(*by, form).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.max_by(F.col(form), F.struct("n", -shout, form)).alias(form))


# Words before which a word is an object, and those before which it is a verb.
DETERMINERS = "the a an this that his her its their my your our los la el whole each every some".split()
PRONOUNS = "he she they i we you it who".split()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(world, word, next) with counts; '.' stands for the end of a run."""
    for b in batches:
        rows: Counter = Counter()
        for world, text in zip(b.column("world").to_pylist(), b.column("content").to_pylist()):
            words = [w for w, _, _ in word_runs(text)]
            rows.update((world, a, z) for a, z in zip(words, [*words[1:], "."]))
        cols = list(zip(*((*k, n) for k, n in rows.items()))) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.string(), pa.int64()])], names=["world", "word", "next", "n"])


def bigrams(entries: DataFrame) -> DataFrame:
    """(world, word, next, n) over the word runs of a book's contents, counted in the task first."""
    rows = spread(entries.select("world", "content")).mapInArrow(_contexts, "world string, word string, next string, n long")
    return rows.groupBy("world", "word", "next").agg(F.sum("n").alias("n"))


def successor_variety(entries: DataFrame) -> DataFrame:
    """(world, word, uses, successors, only): how many different words follow a word, and the one if it is always the same."""
    s = bigrams(entries).filter("word <> '.'").groupBy("world", "word").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("successors"), F.min("next").alias("only"))
    return s.withColumn("only", F.when(F.col("successors") == 1, F.col("only")))


def word_contexts(entries: DataFrame) -> DataFrame:
    """(world, word, before, after_determiner, after_pronoun, verb_head, followed, by_determiner, takes_object): what stands around a word in its book.

    verb_head: seen five times or more, mostly behind a pronoun and hardly ever behind a determiner; takes_object: mostly followed by a determiner.
    """
    pairs = bigrams(entries)
    isin = lambda c, words: F.sum(F.when(F.col(c).isin(words), F.col("n")).otherwise(0))
    before = pairs.filter("next <> '.'").groupBy("world", F.col("next").alias("w")).agg(F.sum("n").alias("before"), isin("word", DETERMINERS).alias("after_determiner"), isin("word", PRONOUNS).alias("after_pronoun"))
    after = pairs.filter("word <> '.'").groupBy("world", F.col("word").alias("w")).agg(F.sum("n").alias("followed"), isin("next", DETERMINERS).alias("by_determiner"))
    both = before.join(after, ["world", "w"], "full_outer").fillna(0).withColumnRenamed("w", "word")
    verb = (F.col("before") >= 5) & (F.col("after_pronoun") / F.col("before") > 0.4) & (F.col("after_determiner") / F.col("before") < 0.1)
    takes = (F.col("followed") >= 2) & (F.col("by_determiner") / F.col("followed") > 0.5)
    return both.withColumn("verb_head", F.coalesce(verb, F.lit(False))).withColumn("takes_object", F.coalesce(takes, F.lit(False)))


def canon(key: Column) -> Column:
    """A key as its words of two letters or more, folded."""
    return F.array_join(F.transform(F.regexp_extract_all(key, F.lit(r"[\p{L}][\p{L}'’-]+"), F.lit(0)), lambda w: T.fold(w)), " ")


def form_votes(entries: DataFrame) -> DataFrame:
    """(world, word, form): how each word of a book is mostly written inside its runs."""
    return form_vote(entries.select("world", "content").mapInArrow(_forms, "world string, word string, form string"), ["world", "word"])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(w, low, core) for w, t in zip(b.column("world").to_pylist(), b.column("content").to_pylist()) for low, core, _ in word_runs(t) if low != "."]
        cols = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["world", "word", "form"])

"""Keys against segments: which keys of which entries match, how often, and what that scores.

Where keys count for their own book only, a book's segments stand behind its keys in one stream, and its automaton says which keys to verify on a
segment, so that no hit is moved. Where they count for all texts, literals and the terms of expressions go into one automaton, in blocks of a stated
size; one pass over the segments finds all of them, whatever their number. A hit is a necessary condition under any flag. A pattern between slashes is
evaluated where a run of characters that all its matches hold stands in the text, or everywhere if none is certain.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import smartkeys as S
from ..session import beside, spread, stored

FLAGS = ("cased", "whole", "secondary", "logic")
KEY_SCHEMA = "world string, entry_id long, pos int, key string, kind string, alerts array<string>, usable boolean, forms array<string>"
PATTERN_BLOCK = 200_000  # patterns an automaton holds; more go in further passes
KEY_BLOCK = 20_000  # expressions and patterns evaluated in one pass; more go in further passes


def _key_rows(carried: list[str], kinds_: list[pa.DataType]):
    """Usable keys of each entry with their kind, alerts and the folded forms to look for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = [], []
            for row, (world, entry, keys) in enumerate(zip(b.column("world").to_pylist(), b.column("entry_id").to_pylist(), b.column("key").to_pylist())):
                for pos, k in enumerate(keys or ()):
                    s = (k or "").strip()
                    if not s:
                        continue
                    alerts = S.validate(s)
                    bad = any(S.ALERTS[a] == "error" for a in alerts)
                    kind = "smart" if s.startswith("?") else "regex" if S.REGEX_KEY.match(s) else "literal"
                    try:
                        forms = [] if bad or kind == "regex" else sorted(set(S.literals(S.leaf(s))))
                    except S.TooDeep:
                        forms = []
                    rows.append((world, entry, pos, s, kind, list(alerts), not bad, forms))
                    at.append(row)
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.string())]
            more = [pa.array([x[i] for i in at], t) for x, t in ((b.column(c).to_pylist(), t) for c, t in zip(carried, kinds_))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), *more], names=["world", "entry_id", "pos", "key", "kind", "alerts", "usable", "forms", *carried])

    return run


def key_table(entries: DataFrame) -> DataFrame:
    """(world, entry_id, pos, key, kind, alerts, usable, forms) of all non-blank keys."""
    return spread(entries.select("world", "entry_id", "key")).mapInArrow(_key_rows([], []), KEY_SCHEMA)


def _flagged_keys(entries: DataFrame) -> DataFrame:
    """``key_table`` with the flags of each key's entry."""
    rows = spread(entries.select("world", "entry_id", "key", *_flag_columns(entries)))
    kinds = [pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.int32()]
    return rows.mapInArrow(_key_rows(list(FLAGS), kinds), f"{KEY_SCHEMA}, cased boolean, whole boolean, secondary array<string>, logic int")


def _automaton(patterns: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        a.add_word(p, (i, len(p)))
    a.make_automaton()
    return a


_built: dict[str, ahocorasick.Automaton] = {}  # a worker builds an automaton once and keeps the last few


def _kept(name: str, patterns: list[str]) -> ahocorasick.Automaton:
    if name not in _built:
        if len(_built) >= 4:
            _built.clear()
        _built[name] = _automaton(patterns)
    return _built[name]


def _hits(name: str, sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = sent.value
        auto = _kept(name, patterns)
        for b in batches:
            at, found, counts = [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                n: dict[int, int] = {}
                end_of: dict[int, int] = {}
                for end, (i, size) in auto.iter(T.fold_text(T.mask_tags(text or ""))):
                    if end - size + 1 > end_of.get(i, -1):  # occurrences of a pattern don't overlap
                        end_of[i] = end
                        n[i] = n.get(i, 0) + 1
                at += [row] * len(n)
                found += [patterns[i] for i in n]
                counts += n.values()
            ids = b.column("seg_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.string()), pa.array(counts, pa.int32())], names=["seg_id", "form", "n"])

    return run


def literal_hits(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """(seg_id, form, n): occurrences of every folded form of the keys in segments (seg_id, text), in one pass a pattern block."""
    forms = keys.filter("usable").select(F.explode("forms").alias("form")).filter("form <> ''").distinct()
    out, block = None, []

    def over(part: list[str]) -> DataFrame:
        sent = segments.sparkSession.sparkContext.broadcast(part)  # at most PATTERN_BLOCK patterns
        return spread(segments.select("seg_id", "text")).mapInArrow(_hits(uuid.uuid4().hex, sent), "seg_id string, form string, n int")

    for r in forms.toLocalIterator():
        block.append(r.form)
        if len(block) == PATTERN_BLOCK:
            out, block = (over(block) if out is None else out.unionByName(over(block))), []
    if block or out is None:
        last = over(block) if block else segments.sparkSession.createDataFrame([], "seg_id string, form string, n int")
        out = last if out is None else out.unionByName(last)
    return out


def _counter(block: list[tuple[str, list[str]]], ways: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, list[int]] = {}
        for i, (_, forms) in enumerate(block):
            for f in forms:
                of.setdefault(f, []).append(i)
        names, nodes = list(of), {}
        auto, holders = _automaton(names), list(of.values())
        n: dict[int, list[int]] = {}
        for b in batches:
            for text in b.column("text").to_pylist():
                seg = S.Segment(text)
                found: set[int] = set()
                for i in {i for _, (i, _) in auto.iter(seg.folded)}:
                    found.update(holders[i])
                for i in found:
                    row = n.setdefault(i, [0, 0, 0])
                    row[0] += 1
                    if ways:
                        if i not in nodes:
                            nodes[i] = (S.leaf(block[i][0], whole=True), S.leaf(block[i][0], cased=True))
                        row[1] += bool(seg.spans(nodes[i][0]))
                        row[2] += bool(seg.spans(nodes[i][1]))
        cols = list(zip(*((block[i][0], *row) for i, row in n.items()))) if n else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), *[pa.int64()] * 3])], names=["key", "n", "as_word", "in_case"])

    return run


def counted_literals(texts: DataFrame, keys: DataFrame, ways: bool = False) -> DataFrame:
    """(key, n, as_word, in_case), a row a task: texts that hold each distinct usable literal key, and, with ``ways``, as a whole word and in its own case."""
    out, block, size = None, [], 0

    def over(part: list[tuple[str, list[str]]]) -> DataFrame:
        return spread(texts.select("text")).mapInArrow(_counter(part, ways), "key string, n long, as_word long, in_case long")

    for r in keys.filter("usable AND kind = 'literal'").select("key", "forms").dropDuplicates(["key"]).toLocalIterator():
        if forms := [f for f in r.forms if f]:
            block.append((r.key, forms))
            size += len(forms)
        if size >= PATTERN_BLOCK:  # all forms of a key are in one block
            out, block, size = (over(block) if out is None else out.unionByName(over(block))), [], 0
    if block or out is None:
        last = over(block) if block else texts.sparkSession.createDataFrame([], "key string, n long, as_word long, in_case long")
        out = last if out is None else out.unionByName(last)
    return out


class _Trees:
    """Gated expressions by key and flags; a bounded number is kept."""

    def __init__(self) -> None:
        self.known: dict[tuple, S.Node | None] = {}

    def get(self, key: str, cased: bool | None, whole: bool | None, secondary: list[str] | None, logic: int | None) -> S.Node | None:
        asked = (key, tuple(secondary or ()), logic, bool(cased), bool(whole))
        if asked not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            try:
                self.known[asked] = S.gated(*asked[:1], list(asked[1]), *asked[2:])
            except S.TooDeep:
                self.known[asked] = None
        return self.known[asked]


class BookKeys:
    """The keys of one book, with what a text must hold for each to be asked."""

    def __init__(self) -> None:
        self.keys: list[tuple] = []
        self.seen: set[tuple] = set()
        self.trees: dict[int, tuple[S.Node | None, dict[int, int]]] = {}
        self.ready = False

    def hold(self, entry: int, key: str, kind: str, forms: list[str], *flags) -> None:
        if (entry, key) not in self.seen:
            self.seen.add((entry, key))
            self.keys.append((entry, key, kind, forms, flags))

    def _sort(self) -> None:
        self.always, self.terms, self.runs, self.ready = [], {}, {}, True
        self.plain: dict[tuple, tuple[S.Node, list[int]]] = {}  # literals without a gate, by what they look for
        self.plain_of: dict[int, tuple] = {}
        self.entries = np.unique(np.array([k[0] for k in self.keys], np.int64))
        self.entry_at = np.searchsorted(self.entries, np.array([k[0] for k in self.keys], np.int64)).tolist()
        for i, (_, key, kind, forms, _) in enumerate(self.keys):
            forms = forms if kind == "literal" or (kind == "smart" and forms and S.needs_term(_tree(key))) else []
            run = S.required_literal(key) if kind == "regex" else None
            for f in forms:
                if f:
                    self.terms.setdefault(f, []).append(i)
            if run:
                self.runs.setdefault(run, []).append(i)
            elif not forms and kind != "literal":
                self.always.append(i)
            cased, whole, secondary, _ = self.keys[i][4]
            if kind == "literal" and not any((k or "").strip() for k in secondary or ()):
                look = (*(T.key_variants(key) if cased else map(str.lower, T.key_variants(key))), bool(cased), bool(whole))
                self.plain.setdefault(look, (S.leaf(key, bool(cased), bool(whole)), []))[1].append(self.entry_at[i])
                self.plain_of[i] = look
        # what each form asks for: what plain literals look for, each once, and the other keys
        self.looks = {f: sorted({self.plain_of[i] for i in of if i in self.plain_of}) for f, of in self.terms.items()}
        self.others = {f: [i for i in of if i not in self.plain_of] for f, of in self.terms.items()}
        self.holders: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.term_names, self.run_names = list(self.terms), list(self.runs)
        self.term_auto, self.run_auto = _automaton(self.term_names), _automaton(self.run_names)

    def asked(self, seg: S.Segment) -> list[int]:
        """Places of the keys that may match a segment."""
        if not self.ready:
            self._sort()
        out = set(self.always)
        for i in {i for _, (i, _) in self.term_auto.iter(seg.folded)} if self.term_names else ():
            out.update(self.terms[self.term_names[i]])
        for i in {i for _, (i, _) in self.run_auto.iter(seg.nfc.casefold())} if self.run_names else ():
            out.update(self.runs[self.run_names[i]])
        return sorted(out)

    def pooled(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places of entries, scores, hits, log weights): ``keyword_scores`` of the texts of one scene."""
        if not self.ready:
            self._sort()
        seen: dict[tuple, int] = {}
        units: dict[tuple[int, int], list] = {}
        weight: dict[int, float] = {}
        for text in texts:
            seg = S.Segment(text)
            looks, asked = set(), set(self.always)
            for i in {i for _, (i, _) in self.term_auto.iter(seg.folded)} if self.term_names else ():
                looks.update(self.looks[self.term_names[i]])
                asked.update(self.others[self.term_names[i]])
            for i in {i for _, (i, _) in self.run_auto.iter(seg.nfc.casefold())} if self.run_names else ():
                asked.update(self.runs[self.run_names[i]])
            for look in looks:
                one = len(look) == 3 and not look[1] and not look[2]  # one spelling, wherever it stands
                if n := seg.folded.count(look[0]) if one else len(seg.spans(self.plain[look][0])):
                    seen[look] = seen.get(look, 0) + n
            for i in asked:
                tree, place = self.tree(i)
                r = S.evaluate(tree, seg)
                if not r.matched:
                    continue
                gated = bool(self.keys[i][4][2]) or self.keys[i][1].startswith("?")
                weight[i] = max(weight.get(i, r.log_weight), r.log_weight)
                for what, mass, n in r.units or [(None, 0.0, 1)]:
                    unit = units.setdefault((i, place.get(what, -1) if gated else -1), [0.0, 0])
                    unit[0] += mass
                    unit[1] += n
        score, hits, log_weight = np.zeros(len(self.entries)), np.zeros(len(self.entries), np.int64), np.full(len(self.entries), -np.inf)
        for look in sorted(seen):
            if look not in self.holders:
                self.holders[look] = np.unique(self.plain[look][1], return_counts=True)
            at, times = self.holders[look]
            score[at] += times * worth(seen[look])
            hits[at] += times
            log_weight[at] = np.maximum(log_weight[at], 0.0)
        for i, w in weight.items():
            at = self.entry_at[i]
            hits[at] += 1
            log_weight[at] = max(log_weight[at], w)
        for (i, _), (mass, n) in sorted(units.items()):
            score[self.entry_at[i]] += mass / n * worth(n) if n > 0 else 0.0
        found = np.flatnonzero(hits)
        return found, score[found], hits[found], log_weight[found]

    def tree(self, i: int) -> tuple[S.Node | None, dict[int, int]]:
        """A key under its entry's flags, and the place of each of its nodes: a unit's name must mean the same in every segment."""
        if i not in self.trees:
            if len(self.trees) > 50_000:
                self.trees.clear()
            _, key, _, _, (cased, whole, secondary, logic) = self.keys[i]
            try:
                tree = S.gated(key, list(secondary or ()), logic, bool(cased), bool(whole))
            except S.TooDeep:
                tree = None
            self.trees[i] = (tree, {id(n): k for k, n in enumerate(S.walk(tree))})
        return self.trees[i]


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, book = None, BookKeys()
    for b in batches:
        rows = []
        for world, share, second, entry, key, kind, forms, seg_id, text, *flags in zip(*(b.column(c).to_pylist() for c in ("world", "share", "second", "entry_id", "key", "kind", "forms", "seg_id", "text", *FLAGS))):
            if (world, share) != at:
                at, book = (world, share), BookKeys()
            if not second:
                book.hold(entry, key, kind, forms, *flags)
                continue
            if not book.keys:
                continue
            seg = S.Segment(text)
            for i in book.asked(seg):
                tree, place = book.tree(i)
                r = S.evaluate(tree, seg)
                if not r.matched:
                    continue
                entry, key, _, _, own = book.keys[i]
                gated = bool(own[2]) or key.startswith("?")
                for what, mass, n in r.units or [(None, 0.0, 1)]:
                    rows.append((entry, key, seg_id, place.get(what, -1) if gated else -1, mass, n, r.log_weight))
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["entry_id", "key", "seg_id", "unit", "mass", "n", "log_weight"])


def worth(n: int, k1: float = 1.2) -> float:
    """``repeat_curve`` of a number, in its default form."""
    return 1 + math.log(1 + (n - 1) / k1)


KEY_COLUMNS = ("entry_id", "key", "kind", "forms", *FLAGS)


def scenes_by_book(batches: Iterator[pa.RecordBatch], new: Callable, held: tuple[str, ...], said: tuple[str, ...]) -> Iterator[tuple]:
    """(book, scene, its rows) of a stream from ``beside`` sorted by chat; ``new()`` makes a book, whose ``hold`` takes the held rows."""
    at, book, scene, rows = None, None, None, []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("world", "share", "second", "chat_id", *held, *said)]
        for world, share, second, chat, *rest in zip(*cols):
            if (world, share) != at or (second and chat != scene):
                if rows:
                    yield book, scene, rows
                scene, rows = chat, []
                if (world, share) != at:
                    at, book = (world, share), new()
            if second:
                rows.append(rest[len(held) :])
            else:
                book.hold(*rest[: len(held)])
    if rows:
        yield book, scene, rows


def _fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, chats, out, n = ["chat_id", "entry_id", "score", "hits", "log_weight"], [], [], 0

    def flushed() -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*out)]
        of = np.repeat(np.arange(len(chats)), [len(x[0]) for x in out])
        return pa.RecordBatch.from_arrays([pa.array(chats, pa.string()).take(pa.array(of)), *map(pa.array, cols)], names=names)

    for book, chat, rows in scenes_by_book(batches, BookKeys, KEY_COLUMNS, ("text",)):
        if not book.keys:
            continue
        found, *rest = book.pooled([t for (t,) in rows])
        chats.append(chat)
        out.append((book.entries[found], *rest))
        n += len(found)
        if n > 20_000:
            yield flushed()
            chats, out, n = [], [], 0
    if out:
        yield flushed()


def fired(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """(chat_id, entry_id, score, hits, log_weight): ``keyword_scores`` of ``match_units``, where segments also have their chat_id.

    A chat's segments follow each other behind the keys of its book, so its units are pooled as they are found and none is moved.
    """
    schema = "chat_id string, entry_id long, score double, hits long, log_weight double"
    return beside(usable_keys(entries), segments.select("world", "chat_id", "text"), "world", "chat_id").mapInArrow(_fired, schema)


def usable_keys(entries: DataFrame) -> DataFrame:
    return _flagged_keys(entries).filter("usable").select("world", *KEY_COLUMNS)


def _parts_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees, last, seg = _Trees(), None, None
    for b in batches:
        rows = []
        for entry, key, seg_id, text, *flags in zip(*(b.column(c).to_pylist() for c in ("entry_id", "key", "seg_id", "text", *FLAGS))):
            if seg_id != last:
                last, seg = seg_id, S.Segment(text)
            for i, part in enumerate(S.parts(trees.get(key, *flags))):
                if S.clusters(part, seg) if part.near is not None else seg.spans(part):
                    rows.append((entry, key, seg_id, i))
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.string(), pa.int32()])], names=["entry_id", "key", "seg_id", "part"])


def _jointly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees = _Trees()
    for b in batches:
        keep = []
        for key, found, *flags in zip(*(b.column(c).to_pylist() for c in ("key", "parts", *FLAGS))):
            tree = trees.get(key, *flags)
            parts = S.parts(tree)
            keep.append(S.holds(tree, {id(parts[i]) for i in found}))
        yield b.filter(pa.array(keep, pa.bool_())).select(["chat_id", "entry_id"])


def _flag_columns(entries: DataFrame) -> list[Column]:
    have = set(entries.columns)
    col = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind)
    return [col("case_sensitive", "boolean").alias("cased"), col("whole_words", "boolean").alias("whole"), col("keysecondary", "array<string>").alias("secondary"), col("selective_logic", "int").alias("logic")]


def key_flags(entries: DataFrame) -> DataFrame:
    """(entry_id, cased, whole, secondary, logic) of entries that may lack some of the columns."""
    return entries.select("entry_id", *_flag_columns(entries))


def _candidates(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """(entry_id, key, seg_id, text, cased, whole, secondary, logic): keys of a segment's book with a form that the segment holds, or without forms."""
    keys = stored(key_table(entries), "keys")
    hits = literal_hits(segments, keys).select("seg_id", "form").join(segments.select("seg_id", "world"), "seg_id")
    by_form = keys.filter("usable AND size(forms) > 0").select("world", "entry_id", "key", F.explode("forms").alias("form"))
    literal = hits.join(by_form, ["world", "form"]).select("entry_id", "key", "seg_id").distinct()
    free = keys.filter("usable AND (kind = 'regex' OR (kind = 'smart' AND size(forms) = 0))").select("world", "entry_id", "key").distinct()
    anywhere = segments.select("world", "seg_id").join(free, "world").select("entry_id", "key", "seg_id")
    cands = literal.unionByName(anywhere).join(segments.select("seg_id", "text"), "seg_id").join(key_flags(entries), "entry_id")
    return cands.select("entry_id", "key", "seg_id", "text", *FLAGS).sortWithinPartitions("seg_id")


def match_units(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """(entry_id, key, seg_id, unit, mass, n, log_weight): scoring units of every key that matches a segment.

    entries: world, entry_id, key, and if present keysecondary, selective_logic, selective, case_sensitive, whole_words.
    segments: seg_id, world (the book they are scanned for), text.
    """
    schema = "entry_id long, key string, seg_id string, unit int, mass double, n int, log_weight double"
    return beside(usable_keys(entries), segments.select("world", "seg_id", "text"), "world", "seg_id").mapInArrow(_matched, schema)


def part_facts(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """(entry_id, key, seg_id, part): the parts of keys (terms, patterns, proximity groups) that a segment holds, whether or not the key matches it."""
    return _candidates(entries, segments).mapInArrow(_parts_found, "entry_id long, key string, seg_id string, part int")


def joint_matches(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """(chat_id, entry_id) of the entries with a key that holds on the parts (chat_id, entry_id, key, part) found in all texts of a chat together."""
    found = facts.groupBy("chat_id", "entry_id", "key").agg(F.collect_set("part").alias("parts"))  # at most the parts of a key
    rows = found.join(key_flags(entries), "entry_id").select("chat_id", "entry_id", "key", "parts", *FLAGS)
    return rows.mapInArrow(_jointly, "chat_id string, entry_id long").distinct()


def repeat_curve(n: Column, k1: float = 1.2, curve: str = "presence-log", r: float = 1.0) -> Column:
    """What n occurrences of one thing are worth."""
    if curve == "presence":
        c = 1 + r * (n - 1) / ((n - 1) + k1)
    elif curve == "presence-log":
        c = 1 + r * F.log(1 + (n - 1) / k1)
    else:
        c = n / (n + k1)
    return F.when(n > 0, c).otherwise(0.0)


def keyword_scores(units: DataFrame, scene_of: DataFrame, k1: float = 1.2, curve: str = "presence-log", r: float = 1.0) -> DataFrame:
    """(chat_id, entry_id, score, hits, log_weight): units pooled over a scene's segments, then saturated, then summed.

    scene_of: (seg_id, chat_id). hits is the number of keys that matched.
    """
    pooled = units.join(scene_of, "seg_id").groupBy("chat_id", "entry_id", "key", "unit").agg(F.sum("mass").alias("mass"), F.sum("n").alias("n"), F.max("log_weight").alias("lw"))
    worth = F.col("mass") / F.col("n") * repeat_curve(F.col("n"), k1, curve, r)
    return pooled.groupBy("chat_id", "entry_id").agg(F.sum(worth).alias("score"), F.countDistinct("key").alias("hits"), F.max("lw").alias("log_weight"))


def unit_counts(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """(form, units): in how many segments each folded form of the keys occurs; segments, never occurrences."""
    return literal_hits(segments, keys).groupBy("form").agg(F.count(F.lit(1)).alias("units"))


def _tree(key: str) -> S.Node | None:
    try:
        return S.leaf(key)
    except S.TooDeep:
        return None


def _evaluated(block: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [_tree(k) for k in block]
        always, by_form, by_run = [], {}, {}
        for i, tree in enumerate(trees):
            if run_ := S.required_literal(block[i]):
                by_run.setdefault(run_, set()).add(i)
                continue
            forms = [f for f in S.literals(tree) if f] if S.needs_term(tree) else []
            for f in forms:
                by_form.setdefault(f, set()).add(i)
            if not forms:
                always.append(i)
        names, runs = list(by_form), list(by_run)
        auto, plain = _automaton(names), _automaton(runs)
        for b in batches:
            rows = []
            for seg_id, text in zip(b.column("seg_id").to_pylist(), b.column("text").to_pylist()):
                asked = set(always)
                for form in {i for _, (i, _) in auto.iter(T.fold_text(T.mask_tags(text or "")))} if names else ():
                    asked |= by_form[names[form]]
                seg = S.Segment(text or "")
                for found in {i for _, (i, _) in plain.iter(seg.nfc.casefold())} if runs else ():
                    asked |= by_run[runs[found]]
                rows += [(block[i], seg_id) for i in sorted(asked) if seg.raw and S.evaluate(trees[i], seg).matched]
            cols = list(zip(*rows)) if rows else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["key", "seg_id"])

    return run


def evaluated_hits(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, seg_id): segments (seg_id, text) that the usable expressions and patterns of the keys match, in one pass a block of keys.

    An expression that no text matches without one of its terms is asked only where the automaton reports a term, a pattern only where a run of characters
    that all its matches hold stands in the text, all others everywhere.
    """
    out, block = None, []

    def over(part: list[str]) -> DataFrame:
        return spread(segments.select("seg_id", "text")).mapInArrow(_evaluated(part), "key string, seg_id string")

    for r in keys.filter("usable AND kind <> 'literal'").select("key").distinct().toLocalIterator():
        block.append(r.key)
        if len(block) == KEY_BLOCK:
            out, block = (over(block) if out is None else out.unionByName(over(block))), []
    if block or out is None:
        last = over(block) if block else segments.sparkSession.createDataFrame([], "key string, seg_id string")
        out = last if out is None else out.unionByName(last)
    return out


def _evaluated_in_book(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees: dict[str, S.Node | None] = {}
    for b in batches:
        rows = []
        for world, keys, text in zip(*(b.column(c).to_pylist() for c in ("world", "keys", "text"))):
            seg = S.Segment(text)
            for k in keys:
                if k not in trees:
                    if len(trees) > 50_000:
                        trees.clear()
                    trees[k] = _tree(k)
                r = S.evaluate(trees[k], seg)
                if r.matched:
                    rows.append((world, k, float(r.boost or 1)))
        cols = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.float64()])], names=["world", "key", "n"])


def evaluated_counts(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """(world, key, n): for each segment (world, text) that a usable expression or pattern of its book matches, the weight or the occurrences."""
    asked = keys.filter("usable AND kind <> 'literal'").groupBy("world").agg(F.collect_set("key").alias("keys"))
    return segments.select("world", "text").join(asked, "world").select("world", "keys", "text").mapInArrow(_evaluated_in_book, "world string, key string, n double")


def excerpts(texts: DataFrame, key: str, width: int = 40, cased: bool = False, whole: bool = False) -> DataFrame:
    """(row_id, at, until, excerpt): each occurrence of a key's terms in texts (row_id, text), with its surroundings and the match in guillemets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = S.leaf(key, cased, whole)
        leaves = [n for n in S.walk(tree) if n.op in ("TERM", "REGEX")]
        for b in batches:
            rows = []
            for i, t in zip(b.column("row_id").to_pylist(), b.column("text").to_pylist()):
                seg = S.Segment(t)
                if not S.evaluate(tree, seg).matched:
                    continue
                for a, e in sorted({span for n in leaves for span in seg.spans(n)}):
                    rows.append((i, a, e, f"{seg.nfc[max(0, a - width):a]}«{seg.nfc[a:e]}»{seg.nfc[e:e + width]}"))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.string()])], names=["row_id", "at", "until", "excerpt"])

    return texts.select("row_id", "text").mapInArrow(run, "row_id long, at int, until int, excerpt string")


def merge_spans(spans: DataFrame, by: list[str], start: str = "at", end: str = "until") -> DataFrame:
    """(by, at, until, n): overlapping spans as one, with the number of members."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = spans.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    island = first.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def score_texts(texts: DataFrame, key: str, mode: str = "strict") -> DataFrame:
    """(row_id, score): what one key of any kind scores on each text (row_id, text) it matches; 1 for a match without weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, float(n)) for i, t in zip(b.column("row_id").to_pylist(), b.column("text").to_pylist()) if (n := S.count_key(key, t or "", mode=mode))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], names=["row_id", "score"])

    return texts.select("row_id", "text").mapInArrow(run, "row_id long, score double")

"""Consistent form of text: what a reader sees, in ordinary characters.

Kernel (plain Python, cached by chunk) and the distributed operator ``form_dictionary``:
look-alike-mapped values are grouped under the accent-sensitive Unicode collation in SQL,
each equivalence class gets one deterministic canonical member, and it is joined back.

Defined results: null stays null; empty and blank texts have no chunk and stay as they are;
a repeated row gives its result again; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored

# Letters of other scripts that look like a Latin letter (lower case, then upper case).
CYRILLIC_TO_LATIN = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "ѵ": "v",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï",
}
GREEK_TO_LATIN = {
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ά": "á", "ό": "ó", "ί": "í", "έ": "é",
}
GREEK_TO_CYRILLIC = {"α": "а", "ο": "о", "ρ": "р", "κ": "к", "χ": "х", "υ": "у", "Α": "А", "Β": "В", "Ε": "Е", "Η": "Н", "Κ": "К", "Μ": "М", "Ο": "О", "Ρ": "Р", "Τ": "Т", "Χ": "Х", "Υ": "У"}
# Letters of the Latin script that are drawn as a plain one.
LATIN_TWINS = {"ɡ": "g", "ɑ": "a"}

_latin_to_cyrillic = {latin: cyr for cyr, latin in reversed(CYRILLIC_TO_LATIN.items())} | {"k": "к", "m": "м", "t": "т"}
_latin_to_greek = {latin: gr for gr, latin in reversed(GREEK_TO_LATIN.items())}
_cyrillic_to_greek = {cyr: gr for gr, cyr in reversed(GREEK_TO_CYRILLIC.items())}
#: target script -> translation of letters that belong to another script
TO_SCRIPT = {
    "L": str.maketrans(CYRILLIC_TO_LATIN | GREEK_TO_LATIN | LATIN_TWINS),
    "C": str.maketrans(_latin_to_cyrillic | GREEK_TO_CYRILLIC),
    "G": str.maketrans(_latin_to_greek | _cyrillic_to_greek),
}

# A chunk is a maximal run of ASCII letters, digits, # and *, and of characters that are not printable ASCII, with one of the latter.
# All that the consistent form can change lies inside one chunk, so texts can be rewritten chunk by chunk.
_ODD = r"[^\t\n\r\x20-\x7e]"
CHUNK = r"(?<![A-Za-z0-9#*])[A-Za-z0-9#*]*+" + _ODD + r"(?:[A-Za-z0-9#*]|" + _ODD + r")*+"
CHUNK_RE = re.compile(CHUNK)

# Necessary condition for a change: a character outside the plain ranges (printable ASCII, composed Latin letters and Latin-1 signs
# without compatibility forms, typographic quotes, dashes, ellipsis, Cyrillic and Greek letters, kana and unified ideographs), or
# letters of two of the scripts Latin, Cyrillic and Greek with only signs of other scripts and digits between. Java and Python read it alike.
_LATIN = r"A-Za-zÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-ž"
_CYRILLIC = r"Ѐ-ҁҊ-ԯ"
_GREEK = r"ΆΈ-ΊΌΎ-ΡΣ-ώ"
_PLAIN = (
    r"\t\n\r\x20-\x7e¡-§©«¬®°±¶·»¿×÷"
    r"‐‒-―‘-‟•…←-⇿、。々-〩ぁ-ゖァ-ヺー一-鿿"
    + _LATIN + _CYRILLIC + _GREEK
)
_OTHER = r"[0-9々-〩ぁ-ゖァ-ヺー一-鿿]*"  # plain signs of a word that are of none of the three
SUSPECT = (
    f"[^{_PLAIN}]|[{_LATIN}]{_OTHER}[{_CYRILLIC}{_GREEK}]|[{_CYRILLIC}]{_OTHER}[{_LATIN}{_GREEK}]|[{_GREEK}]{_OTHER}[{_LATIN}{_CYRILLIC}]"
)
SUSPECT_RE = re.compile(SUSPECT)
COLLATION = "UNICODE"

_emoji = regex.compile(
    r"(?:[0-9#*]️?⃣"
    r"|\p{Regional_Indicator}{2}"
    r"|\p{Extended_Pictographic}[︎️]?[\U0001f3fb-\U0001f3ff]?[\U000e0020-\U000e007f]*"
    r"(?:‍\p{Extended_Pictographic}[︎️]?[\U0001f3fb-\U0001f3ff]?)*)"
)
_unseen = regex.compile(r"[\p{Default_Ignorable_Code_Point}￹-￻\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]+")
_word = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_blank = regex.compile(r"\p{Zs}")


def _plain_letter(ch: str) -> str:
    if unicodedata.category(ch)[0] in "LN":
        plain = unicodedata.normalize("NFKC", ch)
        if plain != ch and all(unicodedata.category(c)[0] in "LMN" for c in plain):
            return plain
    return ch


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x80:
        return "L" if ch.isalpha() else ""
    if 0x400 <= o <= 0x52F or 0x1C80 <= o <= 0x1C8F or 0x2DE0 <= o <= 0x2DFF or 0xA640 <= o <= 0xA69F:
        return "C"
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "G"
    if (0xC0 <= o <= 0x2AF and o not in (0xD7, 0xF7)) or 0x1E00 <= o <= 0x1EFF:
        return "L"
    return ""


def one_script(word: str) -> str:
    """The word in the script of most of its letters; on a tie, in the one all its letters have a look-alike in, Latin first."""
    held: dict[str, int] = {}
    for ch in word:
        if s := _script(ch):
            held[s] = held.get(s, 0) + 1
    if not held or (len(held) == 1 and not ("L" in held and any(c in LATIN_TWINS for c in word))):
        return word
    most = max(held.values())
    best = [s for s in "LCG" if held.get(s) == most]
    if len(best) > 1:
        whole = [s for s in best if all(_script(c) in ("", s) for c in word.translate(TO_SCRIPT[s]))]
        best = whole or best
    table = TO_SCRIPT[best[0]]
    return "".join(ch.translate(table) if _script(ch) != best[0] or ch in LATIN_TWINS else ch for ch in word)


def _seen(chunk: str) -> str:
    out, last = [], 0
    for m in _emoji.finditer(chunk):
        out += [_unseen.sub("", chunk[last : m.start()]), m.group()]
        last = m.end()
    return "".join(out) + _unseen.sub("", chunk[last:])


def mapped_chunk(chunk: str) -> str:
    """The look-alike-mapped value: blanks, compatibility letters and scripts are settled, accents may still be apart."""
    s = _blank.sub(" ", _seen(chunk))
    s = "".join(_plain_letter(ch) if ch > "\x7f" else ch for ch in s)
    return _word.sub(lambda m: one_script(m.group()), s)


@lru_cache(maxsize=200_000)
def chunk_form(chunk: str) -> str:
    """The consistent form of one chunk."""
    if not SUSPECT_RE.search(chunk):
        return chunk
    return _word.sub(lambda m: one_script(m.group()), unicodedata.normalize("NFC", mapped_chunk(chunk)))


def consistent_form(text: str | None) -> str | None:
    """The consistent form of a text; ASCII texts come back at once."""
    if text is None or (text.isascii() and text.isprintable()):
        return text
    if not SUSPECT_RE.search(text):
        return text
    return CHUNK_RE.sub(lambda m: chunk_form(m.group()), text)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        chunks = b.column("chunk").to_pylist()
        mapped = [mapped_chunk(c) for c in chunks]
        composed = [unicodedata.normalize("NFC", m) for m in mapped]
        columns = [chunks, mapped, composed, [_word.sub(lambda m: f"<{len(unicodedata.normalize('NFD', m.group()))}>", c) for c in composed]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["chunk", "mapped", "composed", "between"])


def values(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """All stored values as (field, row_id, pos, value); pos numbers the elements of ``key`` and is 0 otherwise."""
    keys = entries.select(F.lit("key").alias("field"), F.col("entry_id").alias("row_id"), F.posexplode("key").alias("pos", "value"))
    content = entries.select(F.lit("content").alias("field"), F.col("entry_id").alias("row_id"), F.lit(0).alias("pos"), F.col("content").alias("value"))
    mes = messages.select(F.lit("mes").alias("field"), F.col("msg_id").alias("row_id"), F.lit(0).alias("pos"), F.col("mes").alias("value"))
    return keys.unionByName(content).unionByName(mes)


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, chunks = [], []
        for i, value in enumerate(b.column("value").to_pylist()):
            if value and not (value.isascii() and value.isprintable()) and SUSPECT_RE.search(value):
                found = {c for c in CHUNK_RE.findall(value) if SUSPECT_RE.search(c)}
                at += [i] * len(found)
                chunks += sorted(found)
        rows = b.select(["field", "row_id", "pos"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(chunks, pa.string())], names=["field", "row_id", "pos", "chunk"])


def suspect_chunks(vals: DataFrame) -> DataFrame:
    """(field, row_id, pos, chunk) of the chunks that may have to change; the rest is in consistent form by its characters alone.

    One Arrow pass; most texts are plain ASCII and are passed over at once, where a regular expression of the JVM would read each character.
    """
    return spread(vals).mapInArrow(_suspects, "field string, row_id long, pos int, chunk string")


def form_dictionary(chunks: DataFrame) -> DataFrame:
    """(chunk, form) for the distinct chunks.

    The look-alike-mapped values are the members, and their composed spellings; they are grouped under the collation UNICODE (accents and
    case count, composed and decomposed accents don't). The collation passes over signs that are not seen, such as the joiner of emoji, so
    what stands between the words, and the number of letters and accents of each word, is a second key, which can only split a class. The canonical member of a class is a composed one, then the
    shortest, then the first in binary order; it is the answer for every chunk whose mapped value is in the class.
    """
    spark = chunks.sparkSession
    members = chunks.select("chunk").distinct().mapInArrow(_members, "chunk string, mapped string, composed string, between string")
    return spark.sql(
        f"""
        WITH members AS (
          SELECT collate(form, '{COLLATION}') AS class, between, form, apart FROM (
            SELECT mapped AS form, between, mapped <> composed AS apart FROM {{members}}
            UNION ALL SELECT composed, between, false FROM {{members}})),
        canonical AS (
          SELECT class, between, min(struct(apart, char_length(form) AS n, form)).form AS form
          FROM members GROUP BY class, between)
        SELECT m.chunk, c.form
        FROM {{members}} m JOIN canonical c ON collate(m.mapped, '{COLLATION}') = c.class AND m.between = c.between
        """,
        members=members,
    )


def inconsistent_values(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """(field, row_id) of the rows with a stored value that isn't in consistent form."""
    chunks = stored(suspect_chunks(values(entries, messages)), "suspect-chunks")
    changed = form_dictionary(chunks).filter(F.col("chunk") != F.col("form")).select("chunk")
    return chunks.join(changed, "chunk", "left_semi").select("field", "row_id").distinct()


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for value, pairs in zip(b.column("value").to_pylist(), b.column("pairs").to_pylist()):
            forms = {p["chunk"]: p["form"] for p in pairs or ()}
            out.append(CHUNK_RE.sub(lambda m: forms.get(m.group(), m.group()), value) if forms else value)
        yield pa.RecordBatch.from_arrays([b.column("field"), b.column("row_id"), b.column("pos"), pa.array(out, pa.string())], names=["field", "row_id", "pos", "form"])


def consistent_values(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """(field, row_id, pos, form) of every stored value. Values without a suspect character pass by without a shuffle."""
    vals = values(entries, messages)
    chunks = stored(suspect_chunks(vals), "suspect-chunks")
    forms = form_dictionary(chunks).filter(F.col("chunk") != F.col("form"))
    at = ["field", "row_id", "pos"]
    pairs = chunks.join(forms, "chunk").groupBy(*at).agg(F.collect_list(F.struct("chunk", "form")).alias("pairs"))
    # a changed value holds a character beyond ASCII or a control character
    beyond = F.coalesce((F.octet_length("value") != F.length("value")) | F.col("value").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), F.lit(False))
    odd = vals.filter(beyond).join(pairs, at, "left").select(*at, "value", "pairs")
    plain = vals.filter(~beyond).select(*at, F.col("value").alias("form"))
    return plain.unionByName(odd.mapInArrow(_rewrite, "field string, row_id long, pos int, form string"))

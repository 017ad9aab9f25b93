"""Evaluation texts leaking into training text, by a distributed positional inverted index.

The training words are stored as postings: a row of the index is a block of documents with its words, and for each word the documents and
places where it stands. In each stretch of WINDOW item words the RAREST words by document frequency in all blocks are the anchors. Their
posting lists, with the item's offset taken off, must agree for at least AGREE anchors up to a shift of SHIFT. What is left is verified word
by word on the block's postings: a passage of 20 words with at most 2 edits, or of 30 with at most 3. Any longer passage with at most one
edit in ten words holds one of these.

Why no passage is lost: 3 edits leave at least 3 of a stretch's 6 rarest words, and shift them by at most 3.

Plan: a block holds all postings of its documents, so a look-up moves none: only the words' frequencies are shuffled. The items are a
table; their anchors are chosen by the executors, and buckets of about BUCKET_WORDS item words are sent to the tasks, one pass over the index each.
What a task holds of the corpus is bounded by BLOCK_WORDS or one document.

Defined results: null, empty and blank documents and items match nothing; repeated documents are found each, repeated passages
of a document once; items shorter than 20 words match nothing; repeated items of one id are found once; a very long document
is a block of its own; empty tables give no rows; extra columns are ignored. Ties among anchors are settled by place.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored
from .forms import consistent_form

WINDOW, RAREST, AGREE, SHIFT = 20, 6, 3, 3
PASSAGES = ((20, 2), (30, 3))  # words, edits allowed
BLOCK_WORDS = 100_000
BUCKET_WORDS = 200_000  # item words that one pass over the index looks for
SLICE = 1 << 21  # places that are compared at once

_word = re.compile(r"[^\W_]+(?:['’ʼ][^\W_]+)*")
_apostrophes = str.maketrans("", "", "'’ʼ")
_instruction = re.compile(r"\s*([^\n]+?)[ \t\r]*\n[ \t\r]*\n")


def words_of(text: str | None) -> list[str]:
    """The words a passage is made of: consistent form, lower case, without punctuation; an apostrophe inside a word is dropped."""
    return _word.findall(consistent_form(text).lower().translate(_apostrophes)) if text else []


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
            m = _instruction.match(t) if t else None
            rows.append((i, m[1] if m else None, words_of(t), words_of(t[m.end() :]) if m else None))
        cols = list(zip(*rows)) if rows else [()] * 4
        kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["item_id", "opening", "whole", "body"])


def item_words(items: DataFrame, least: int = 3) -> DataFrame:
    """(item_id, words) of the items of at least WINDOW words, without the instruction line: an opening line, set off by an empty one, that several items share."""
    rows = stored(items.select("item_id", "text").mapInArrow(_opened, "item_id long, opening string, whole array<string>, body array<string>"), "opened-items")
    shared = rows.filter("opening IS NOT NULL").groupBy("opening").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    words = F.when(F.col("n").isNotNull(), F.col("body")).otherwise(F.col("whole")).alias("words")
    return rows.join(shared, "opening", "left").select("item_id", words).filter(F.size("words") >= WINDOW).distinct()


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: ids and numbers of words; terms, in how many documents each stands, numbers of postings; documents and places by term."""
    names = ["ids", "lengths", "terms", "n_docs", "sizes", "docs", "places"]

    def out(ids: list[int], lengths: list[int], number: dict[str, int], text: list[int]) -> pa.RecordBatch:
        words, sizes = np.array(text, np.int32), np.bincount(text).astype(np.int32)
        ends = np.cumsum(lengths)
        order = np.argsort(words, kind="stable")
        docs = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)[order]
        places = (np.arange(len(words)) - np.repeat(ends - lengths, lengths))[order].astype(np.int32)
        first = np.ones(len(words), bool)
        first[1:] = (words[order][1:] != words[order][:-1]) | (docs[1:] != docs[:-1])
        n_docs = np.bincount(words[order][first]).astype(np.int32)
        binary = lambda x: pa.array([x.tobytes()], pa.binary())
        cols = [binary(np.array(ids, np.int64)), binary(np.array(lengths, np.int32)), pa.array([list(number)], pa.list_(pa.string())), pa.array([n_docs], pa.list_(pa.int32())), binary(sizes), binary(docs), binary(places)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def fresh() -> tuple[list[int], list[int], dict[str, int], list[int]]:
        return [], [], defaultdict(count().__next__), []

    ids, lengths, number, text = fresh()
    for b in batches:
        for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            if words := words_of(t):
                text += [number[w] for w in words]
                ids.append(doc_id)
                lengths.append(len(words))
                if len(text) >= BLOCK_WORDS:
                    yield out(ids, lengths, number, text)
                    ids, lengths, number, text = fresh()
    if ids:
        yield out(ids, lengths, number, text)


def build_index(documents: DataFrame) -> DataFrame:
    """The positional index of documents (doc_id, text), stored in the shared folder; one row a block."""
    schema = "ids binary, lengths binary, terms array<string>, n_docs array<int>, sizes binary, docs binary, places binary"
    return stored(spread(documents.select("doc_id", "text")).mapInArrow(_postings, schema), "positional-index")


def anchors(df: list[int]) -> list[int]:
    """Places of the words that are among the rarest of some stretch of WINDOW words, by the document frequencies of an item's words in order."""
    picked: set[int] = set()
    for start in range(max(1, len(df) - WINDOW + 1)):
        picked.update(sorted(range(start, min(start + WINDOW, len(df))), key=lambda p: (df[p], p))[:RAREST])
    return sorted(picked)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(0), b.column(1), pa.array([[p for p in anchors(df) if df[p]] for df in b.column(2).to_pylist()], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, names=["item_id", "words", "points"])


def anchored(index: DataFrame, words: DataFrame) -> DataFrame:
    """(item_id, words, points): the items with the places of their anchors; words that no document holds are none."""
    spelled = words.select("item_id", F.xxhash64("words").alias("copy"), F.posexplode("words").alias("place", "term"))
    terms = index.select(F.explode(F.arrays_zip("terms", "n_docs")).alias("t")).select("t.terms", "t.n_docs").withColumnRenamed("terms", "term")
    df = terms.join(spelled.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    order = F.array_sort(F.collect_list(F.struct("place", "term", F.coalesce("df", F.lit(0)).alias("df")))).alias("w")
    return spelled.join(df, "term", "left").groupBy("item_id", "copy").agg(order).select("item_id", "w.term", "w.df").mapInArrow(_anchored, "item_id long, words array<string>, points array<int>")


def best_passages(items: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """[row, edits]: most item words of a passage near a diagonal, starting and ending on equal words; 0 for none.

    Each row is an item, filled up with -1, and the document's words from SHIFT before to SHIFT behind the item's places on that diagonal, those outside
    the document as -3.
    """
    rows, most, width = len(items), max(k for _, k in PASSAGES), 2 * SHIFT + 1
    far = items.shape[1] + 1
    # start[row, s, k]: first item word of the longest passage that ends before item word i on the diagonal + s - SHIFT, with k edits
    start = np.full((rows, width, most + 1), far)
    best = np.zeros((rows, most + 1), np.int64)
    for i in range(items.shape[1]):
        equal = (pieces[:, i : i + width] == items[:, i, None])[:, :, None]
        after = np.full_like(start, far)
        after[:, :, 1:] = start[:, :, :-1]  # changed
        after = np.where(equal, np.minimum(start, i), after)
        after[:, :-1, 1:] = np.minimum(after[:, :-1, 1:], start[:, 1:, :-1])  # dropped from the document
        for s in range(1, width):
            after[:, s, 1:] = np.minimum(after[:, s, 1:], after[:, s - 1, :-1])  # added in the document
        best = np.maximum(best, np.where(equal & (after < far), i + 1 - after, 0).max(1))
        start = after
    return best


def may_hold(item: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Which pieces (as above) meet a necessary condition for a passage: a stretch in which all item words but the edits stand within SHIFT of the diagonal."""
    n = len(item)
    found = np.zeros((len(pieces), n), bool)
    for s in range(2 * SHIFT + 1):
        found |= pieces[:, s : s + n] == item
    sums = np.concatenate([np.zeros((len(pieces), 1), np.int32), np.cumsum(found, 1, dtype=np.int32)], 1)
    out = np.zeros(len(pieces), bool)
    for words, edits in PASSAGES:
        if n >= words:
            out |= (sums[:, words:] - sums[:, :-words]).max(1) >= words - edits
    return out


class Bucket:
    """Items to look for: their words as numbers, and the asked places of each word."""

    def __init__(self, rows: list[tuple[int, list[str], list[int]]]):
        self.number: dict[str, int] = {}
        self.ids = [i for i, _, _ in rows]
        self.words = [np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int64) for _, words, _ in rows]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        asks = np.array([(words[p], i, p) for i, (words, (_, _, points)) in enumerate(zip(self.words, rows)) for p in points], np.int64).reshape(-1, 3)
        self.terms, self.items, self.places = asks[:, 0], asks[:, 1], asks[:, 2]

    def agreeing(self, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, places: np.ndarray, n_docs: int) -> np.ndarray:
        """Rows (item, document, diagonal) where AGREE anchors agree up to SHIFT. starts and sizes: the posting list of each word of the bucket."""
        pairs = sizes[self.terms]  # every place of a posting list meets every asked place of its word
        total = np.concatenate([[0], np.cumsum(pairs)])
        ends = np.searchsorted(self.items, np.arange(len(self.ids)), side="right")
        out, lo = [np.zeros((0, 3), np.int64)], 0
        while lo < len(pairs):  # as many items at once as have SLICE pairs, at least one
            fit = int(np.searchsorted(total[ends], total[lo] + SLICE, side="right"))
            hi = int(max(ends[self.items[lo]], ends[fit - 1] if fit else 0))
            at = np.repeat(np.arange(lo, hi), pairs[lo:hi])
            post = starts[self.terms[at]] + np.arange(len(at)) + total[lo] - total[at]
            key = ((self.items[at] * n_docs + docs[post]) << 31) + (places[post] - self.places[at] + (1 << 30))
            key.sort()
            if len(key) >= AGREE:
                key = np.unique(key[: len(key) - AGREE + 1][key[AGREE - 1 :] - key[: len(key) - AGREE + 1] <= SHIFT])
                pair, diagonal = key >> 31, (key & ((1 << 31) - 1)) - (1 << 30)
                out.append(np.stack([pair // n_docs, pair % n_docs, diagonal], 1))
            lo = hi
        return np.concatenate(out)

    def passages(self, ids: np.ndarray, lengths: np.ndarray, terms: list[str], sizes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(doc_id, item_id, n_words, n_edits) of a block's documents."""
        number = np.array([self.number.get(t, -2) for t in terms], np.int64)
        known = np.flatnonzero(number >= 0)
        start, size = np.zeros((2, len(self.number)), np.int64)
        start[number[known]], size[number[known]] = (np.cumsum(sizes) - sizes)[known], sizes[known]
        found = self.agreeing(start, size, docs, places, len(ids))
        if not len(found):
            return []
        begins = np.cumsum(lengths) - lengths
        texts = np.empty(int(lengths.sum()), np.int64)
        texts[begins[docs] + places] = np.repeat(number, sizes)
        piece = lambda doc, diagonal, n: self._pieces(texts, begins[doc], lengths[doc], diagonal, n)
        likely = [np.zeros((0, 3), np.int64)]
        for i, lo, hi in zip(*(x.tolist() for x in _runs(found[:, 0]))):
            step = max(1, SLICE // len(self.words[i]))
            for at in range(lo, hi, step):
                part = found[at : min(at + step, hi)]
                likely.append(part[may_hold(self.words[i], piece(part[:, 1], part[:, 2], len(self.words[i])))])
        found = np.concatenate(likely)
        found = found[np.argsort(self.sizes[found[:, 0]], kind="stable")]  # items of like length together
        best: dict[tuple[int, int], tuple[int, int]] = {}
        lo = 0
        while lo < len(found):
            hi = lo + max(1, SLICE // 8 // int(self.sizes[found[min(lo + 1024, len(found)) - 1, 0]]))
            part = found[lo : min(hi, lo + 1024)]
            lo += len(part)
            n = int(self.sizes[part[:, 0]].max())
            items = np.full((len(part), n), -1)
            for row, i in zip(items, part[:, 0]):
                row[: self.sizes[i]] = self.words[i]
            longest = best_passages(items, piece(part[:, 1], part[:, 2], n))
            # edits count from the fewest: a passage with more edits is taken only if it is longer
            enough = np.array([min((w for w, e in PASSAGES if k <= e), default=1 << 40) for k in range(longest.shape[1])])
            value = np.where(longest >= enough, longest * 8 + 7 - np.arange(longest.shape[1]), 0).max(1)
            for (i, d, _), v in zip(part.tolist(), value.tolist()):
                if v:
                    pair = (d, self.ids[i])
                    best[pair] = max((v // 8, v % 8 - 7), best.get(pair, (0, 0)))
        return [(int(ids[d]), i, n, -k) for (d, i), (n, k) in best.items()]

    @staticmethod
    def _pieces(texts: np.ndarray, begins: np.ndarray, lengths: np.ndarray, diagonals: np.ndarray, n: int) -> np.ndarray:
        place = diagonals[:, None] + np.arange(-SHIFT, n + SHIFT)
        inside = (place >= 0) & (place < lengths[:, None])
        return np.where(inside, texts[np.where(inside, begins[:, None] + place, 0)], -3)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and ends of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[starts], starts, np.append(starts[1:], len(x))


def _search(bucket: Bucket) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, lengths, terms, sizes, docs, places in zip(*(b.column(c).to_pylist() for c in ("ids", "lengths", "terms", "sizes", "docs", "places"))):
                numbers = [np.frombuffer(x, np.int32).astype(np.int64) for x in (lengths, sizes, docs, places)]
                rows = bucket.passages(np.frombuffer(ids, np.int64), numbers[0], terms, *numbers[1:])
                cols = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])], names=["doc_id", "item_id", "n_words", "n_edits"])

    return run


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, n_edits) of every document that holds a passage of an item: the longest passage, then the fewest edits."""
    index = build_index(documents)
    asked = stored(anchored(index, item_words(items)), "anchored-items")
    buckets = -(-(asked.agg(F.sum(F.size("words"))).first()[0] or 0) // BUCKET_WORDS)
    out = documents.sparkSession.createDataFrame([], "doc_id long, item_id long, n_words int, n_edits int")
    for i in range(buckets):
        part = asked.filter(F.pmod(F.coalesce(F.xxhash64("item_id"), F.lit(0)), F.lit(buckets)) == i)
        bucket = Bucket([(r.item_id, r.words, r.points) for r in part.collect()])  # about BUCKET_WORDS words
        found = index.select("ids", "lengths", "terms", "sizes", "docs", "places").mapInArrow(_search(bucket), "doc_id long, item_id long, n_words int, n_edits int")
        out = found if i == 0 else out.unionByName(found)
    return out

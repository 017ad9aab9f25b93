"""How distinctive a term is per record: parsimonious language models.

Per record, expectation-maximisation separates the record's own term mass from the background probabilities of its field;
the converged probability of a term ranks it. Terms that the background explains go to zero, rare repeated ones take the mass.

Plan: one pass packs records into blocks (a vocabulary, and a binary of term indexes and counts by record) that are stored in the
shared folder. Counts over the collection are sums of the blocks' counts. The background is joined to each block's vocabulary,
not to each record's terms: frequent terms (at most 1/HEAVY_SHARE a field) by broadcast, all others by a shuffle join. EM then
runs over a whole block in numpy. A block is bounded by BLOCK_TOKENS, so no task holds more than one block and its vocabulary.

Defined results: null and blank texts give no rows; repeated rows are scored each by itself and count each in the background;
a very long text is a block of its own; an empty table gives no rows; equal scores are left unranked (row_number is up to the
reader); extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored
from .terms import counted_messages, terms_of

BLOCK_TOKENS = 200_000
BLOCK_RECORDS = 8_192
HEAVY_SHARE = 1 / 20_000  # of a field's tokens: at most 20,000 terms a field are broadcast
MIX = 0.1  # weight of the record's own model in the mixture
TOLERANCE = 1e-6
MAX_ROUNDS = 300
BLOCKS = "block string, field string, terms array<string>, cf array<int>, df array<int>, payload binary"
SCORES = "field string, row_id long, term string, tf int, n_records long, score double"


def records(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """(field, row_id, text) of all entries' contents and all counted messages."""
    content = entries.select(F.lit("content").alias("field"), F.col("entry_id").alias("row_id"), F.col("content").alias("text"))
    return counted_messages(messages).select(F.lit("mes").alias("field"), F.col("msg_id").alias("row_id"), F.col("mes").alias("text")).unionByName(content)


def _small(a: np.ndarray) -> np.ndarray:
    most = int(a.max()) if a.size else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def pack(rows: list[int], sizes: list[int], idx: list[int], tf: list[int]) -> bytes:
    """A block's records: a head of lengths and widths, then row ids, distinct terms by record, term indexes, counts."""
    parts = [np.asarray(rows, np.int64), _small(np.asarray(sizes, np.int64)), _small(np.asarray(idx, np.int64)), _small(np.asarray(tf, np.int64))]
    head = np.array([x for p in parts for x in (p.size, p.dtype.itemsize)], np.int64)
    return head.tobytes() + b"".join(p.tobytes() for p in parts)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    head, at, out = np.frombuffer(payload, np.int64, 8), 64, []
    for n, width in head.reshape(4, 2):
        out.append(np.frombuffer(payload, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[int(width)], int(n), at).astype(np.int64))
        at += int(n * width)
    return out[0], out[1], out[2], out[3]


class _Block:
    def __init__(self, field: str):
        self.field, self.ids, self.cf, self.df = field, {}, [], []
        self.rows, self.sizes, self.idx, self.tf, self.tokens = [], [], [], [], 0

    def add(self, row_id: int, counts: Counter) -> None:
        ids, cf, df = self.ids, self.cf, self.df
        for term, n in counts.items():
            i = ids.get(term)
            if i is None:
                i = ids[term] = len(cf)
                cf.append(0)
                df.append(0)
            cf[i] += n
            df[i] += 1
            self.idx.append(i)
        self.tf += counts.values()
        self.rows.append(row_id)
        self.sizes.append(len(counts))
        self.tokens += counts.total()

    def batch(self) -> pa.RecordBatch:
        cols = [uuid.uuid4().hex, self.field, list(self.ids), self.cf, self.df, pack(self.rows, self.sizes, self.idx, self.tf)]
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds)], names=["block", "field", "terms", "cf", "df", "payload"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_blocks: dict[str, _Block] = {}
    for b in batches:
        for field, row_id, text in zip(b.column("field").to_pylist(), b.column("row_id").to_pylist(), b.column("text").to_pylist()):
            if found := terms_of(text):
                block = open_blocks.get(field) or open_blocks.setdefault(field, _Block(field))
                block.add(row_id, Counter(found))
                if block.tokens >= BLOCK_TOKENS or len(block.rows) >= BLOCK_RECORDS:
                    yield open_blocks.pop(field).batch()
    for block in open_blocks.values():
        yield block.batch()


def parsimonious(rec: np.ndarray, tf: np.ndarray, background: np.ndarray, n: int) -> np.ndarray:
    """Converged own probabilities for pairs (record rec of n, in order; count tf; background probability).

    A record whose probabilities all change by less than TOLERANCE in a round has converged and leaves the rounds.
    """
    tf = tf.astype(float)
    own = tf / np.bincount(rec, tf, n)[rec]
    out, at, rest = own.copy(), np.arange(len(rec)), (1 - MIX) / MIX * background
    for r in range(MAX_ROUNDS):
        mass = tf * own
        mass /= own + rest
        after = mass / np.bincount(rec, mass, n)[rec]
        if r % 4 == 3:
            moved = np.zeros(n, bool)
            moved[rec[np.abs(after - own) >= TOLERANCE]] = True
            stay = moved[rec]
            if not stay.all():
                out[at] = after
                at, rec, tf, rest, after = at[stay], rec[stay], tf[stay], rest[stay], after[stay]
                if not len(at):
                    return out
                _, rec = np.unique(rec, return_inverse=True)
                n = int(rec[-1]) + 1
        own = after
    out[at] = own
    return out


def _score(totals: dict[str, int], min_tf: int, max_df: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for field, terms, payload, stats in zip(*(b.column(c) for c in ("field", "terms", "payload", "stats"))):
                field, flat = field.as_py(), stats.values
                cf, df = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
                at = flat.field("idx").to_numpy(zero_copy_only=False)
                cf[at], df[at] = flat.field("cf").to_numpy(zero_copy_only=False), flat.field("df").to_numpy(zero_copy_only=False)
                rows, sizes, idx, tf = unpack(payload.as_py())
                rec = np.repeat(np.arange(len(rows)), sizes)
                score = parsimonious(rec, tf, cf[idx] / totals[field], len(rows))
                keep = tf >= min_tf
                if max_df is not None:
                    keep &= df[idx] <= max_df
                keep = np.flatnonzero(keep)
                words = terms.values.take(pa.array(idx[keep]))
                cols = [pa.array([field] * len(keep), pa.string()), pa.array(rows[rec[keep]]), words.cast(pa.string()), pa.array(tf[keep].astype(np.int32)), pa.array(df[idx[keep]]), pa.array(score[keep])]
                yield pa.RecordBatch.from_arrays(cols, names=["field", "row_id", "term", "tf", "n_records", "score"])

    return run


def term_scores(recs: DataFrame, min_tf: int = 1, max_df: int | None = None) -> DataFrame:
    """(field, row_id, term, tf, n_records, score) of each record's terms.

    Every record is scored over all its terms; ``min_tf`` and ``max_df`` only choose which of them are returned.
    """
    blocks = stored(spread(recs).mapInArrow(_blocks, BLOCKS), "term-blocks")
    zipped = F.explode(F.arrays_zip("terms", "cf", "df")).alias("x")
    counts = blocks.select("field", zipped).groupBy("field", F.col("x.terms").alias("term")).agg(F.sum("x.cf").cast("long").alias("cf"), F.sum("x.df").cast("long").alias("df"))
    counts = stored(counts, "term-counts")
    totals = {r.field: r.n for r in counts.groupBy("field").agg(F.sum("cf").alias("n")).collect()}
    least = F.element_at(F.create_map(*[F.lit(x) for f, n in totals.items() for x in (f, max(1, int(n * HEAVY_SHARE)))]), F.col("field")) if totals else F.lit(1)
    heavy, light = F.broadcast(counts.filter(F.col("cf") > least)), counts.filter(F.col("cf") <= least)
    words = blocks.select("block", "field", F.posexplode("terms").alias("idx", "term"))
    on, out = ["field", "term"], ["block", "idx", "cf", "df"]
    known = words.join(heavy, on).select(*out).unionByName(words.join(heavy.select(*on), on, "left_anti").join(light, on).select(*out))
    stats = known.groupBy("block").agg(F.collect_list(F.struct("idx", "cf", "df")).alias("stats"))
    return blocks.select("block", "field", "terms", "payload").join(stats, "block").select("field", "terms", "payload", "stats").mapInArrow(_score(totals, min_tf, max_df), SCORES)

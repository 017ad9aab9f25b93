"""The chunk index: what to add, drop, reuse, and embed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lexical import chunks
from ..operators.scenes import eligible


def wanted(entries: DataFrame, mode: str = "paragraph", size: int = 1750, least: int = 120) -> DataFrame:
    """(entry_id, pos, text, hash): chunks an index should hold; the hash is of text and entry."""
    return chunks(eligible(entries), mode, size, least).withColumn("hash", F.xxhash64("text", "entry_id"))


def sync_plan(wanted_chunks: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, hashes to delete)."""
    return wanted_chunks.join(saved.select("hash"), "hash", "left_anti"), saved.select("hash").join(wanted_chunks.select("hash"), "hash", "left_anti")


def adopt(missing: DataFrame, siblings: DataFrame, dim: int) -> DataFrame:
    """(hash, vector) for missing hashes that another collection holds at the same size; the newest one counts."""
    fit = siblings.filter(F.size("vector") == dim)
    return fit.join(missing.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.max_by("vector", F.struct("mtime", "collection")).alias("vector"))


def hash_embedding(texts: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic stand-in for an embedding service: signed feature hashing of words."""
    import zlib

    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        h = np.array([zlib.crc32(w.encode()) for w in t.lower().split()], np.int64)
        out[i] = np.bincount(h % dim, np.where(h & 1 << 31, 1, -1), dim)
    return out


def embed(rows: DataFrame, service: Callable[[list[str]], np.ndarray] = hash_embedding, batch: int = 25) -> DataFrame:
    """``rows`` (hash, text) with vector, the service called on batches of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            vs = [v for i in range(0, len(texts), batch) for v in np.asarray(service(texts[i : i + batch]), np.float32).tolist()]
            yield pa.RecordBatch.from_arrays([b.column("hash"), b.column("text"), pa.array(vs, pa.list_(pa.float32()))], names=["hash", "text", "vector"])

    return rows.select("hash", "text").mapInArrow(run, "hash long, text string, vector array<float>")


def orphan_collections(stored_: DataFrame, live: DataFrame) -> DataFrame:
    """(collection, bytes) of stored collections that no live book maps to, and their sum by rollup."""
    lost = stored_.join(live.select("collection"), "collection", "left_anti")
    return lost.rollup("collection").agg(F.sum("bytes").alias("bytes"))


def adopt_hashes(entries: DataFrame, host: DataFrame) -> DataFrame:
    """``entries`` (world, uid, hash) with the host's hash where it knows the entry (world, uid, hash)."""
    theirs = host.select("world", "uid", F.col("hash").alias("_h"))
    return entries.join(theirs, ["world", "uid"], "left").withColumn("hash", F.coalesce("_h", "hash")).drop("_h")


def admit_ceiling(pooled: bool, entries: int = 1000, chunks_: int = 10_000) -> int:
    """How many rows a search returns before they are pooled, or after."""
    return entries if pooled else chunks_

"""Index maintenance from a stream of entry versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.index import embed, sync_plan, wanted


def index_writer(path: str, dim: int = 64):
    """A ``foreachBatch`` function: new and changed entries are chunked, and only chunks the index lacks are embedded.

    The index is append-only files by batch; a tombstone row marks a dropped chunk, so a replayed batch writes the same folder again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy("entry_id").agg(F.max(F.struct("saved_at", *[c for c in batch.columns if c not in ("entry_id", "saved_at")])).alias("e")).select("entry_id", "e.*")
        want = wanted(latest).select("hash", "text", "entry_id")
        held = current_index(spark, path, below=batch_id)
        mine = held.join(latest.select("entry_id"), "entry_id", "left_semi") if held is not None else want.limit(0)
        add, drop = sync_plan(want, mine)
        rows = embed(add).join(add.select("hash", "entry_id"), "hash").select("hash", "entry_id", "vector", F.lit(False).alias("gone"))
        dead = mine.select("hash", "entry_id").join(drop, "hash", "left_semi").select("hash", "entry_id", F.lit(None).cast("array<float>").alias("vector"), F.lit(True).alias("gone"))
        rows.unionByName(dead).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current_index(spark, path: str, below: int | None = None) -> DataFrame | None:
    """(hash, entry_id, vector) as of the last batch; None before the first."""
    try:
        rows = spark.read.option("basePath", path).parquet(path)
    except Exception:  # no batch has been written
        return None
    rows = rows.filter(F.col("batch") < below) if below is not None else rows
    last = rows.groupBy("hash").agg(F.max_by(F.struct("entry_id", "vector", "gone"), "batch").alias("x"))
    return last.filter("NOT x.gone").select("hash", "x.entry_id", "x.vector")

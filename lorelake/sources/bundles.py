"""Graded bundles: nested documents of scenes, arms, candidates and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def read_bundles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Bundle documents, one a file, or one a line, which can be split among tasks."""
    return spark.read.schema(schema.BUNDLE).option("multiLine", not lines).json(path)


def candidates(bundles: DataFrame) -> DataFrame:
    """(capture_id, scene_id, arm, book, uid, title, cosine, text, keys, rank, grades): one flat row an arm and candidate."""
    arms = bundles.select("capture_id", "scene_id", F.explode("arms").alias("a"))
    return arms.select("capture_id", "scene_id", F.col("a.arm").alias("arm"), F.explode("a.rows").alias("r")).select("capture_id", "scene_id", "arm", "r.*")


def bundle_raters(bundles: DataFrame) -> DataFrame:
    return bundles.select("capture_id", F.posexplode("raters").alias("rater", "r")).select("capture_id", "rater", "r.*")


def build_bundles(items: DataFrame, raters: DataFrame, version: str = "3.1") -> DataFrame:
    """Bundles from graded rows (capture_id, scene_id, book, uid, title, grades) and raters (capture_id, rater, ...); raters keep their index."""
    who = raters.groupBy("capture_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rater", F.struct("kind", "rater_id", "model_name", "family", "quant").alias("r")))), lambda x: x["r"]).alias("raters"))
    row = F.struct("book", "uid", "title", *[F.lit(None).cast(t).alias(n) for n, t in (("cosine", "double"), ("text", "double"), ("keys", "double"), ("rank", "int"))], "grades")
    rows = items.groupBy("capture_id").agg(F.min("scene_id").alias("scene_id"), F.sort_array(F.collect_list(F.struct("book", "uid", row.alias("r")))).alias("rows"))
    arms = F.array(F.struct(F.lit("baseline").alias("arm"), F.transform("rows", lambda x: x["r"]).alias("rows")))
    return rows.join(who, "capture_id", "left").select(F.lit(version).alias("version"), "capture_id", "scene_id", F.lit(None).cast("string").alias("query"), F.lit(None).cast("int").alias("depth"), "raters", arms.alias("arms"))


def book_hashes(entries: DataFrame) -> DataFrame:
    """(world, hash): SHA-256 of a book's canonical JSON: entries by uid, fields by name. An entry's hash first, so books are never one string of all contents."""
    fields = sorted(c for c in entries.columns if c != "world")
    each = entries.select("world", "uid", F.sha2(F.to_json(F.struct(*fields)), 256).alias("h"))
    return each.groupBy("world").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("uid", "h"))), lambda x: x["h"]), ""), 256).alias("hash"))


def slice_rows(rows: DataFrame, shortlist: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(shortlist.select(*by).distinct(), by, "left_semi")


def scene_slug(c: Column) -> Column:
    """A name as part of a file name."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")

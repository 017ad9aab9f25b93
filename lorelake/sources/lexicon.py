"""Language packs: packed word frequencies, and building them from n-gram counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unpack(packs: DataFrame) -> DataFrame:
    """(lang, word, zipf) of packs (lang, packed): bands ``decile:word word ...`` set apart by semicolons, a decile being ten times the Zipf value."""
    bands = packs.select("lang", F.explode(F.split("packed", ";")).alias("band")).filter(F.col("band").contains(":"))
    at = F.split("band", ":", 2)
    return bands.select("lang", (at[0].cast("double") / 10).alias("zipf"), F.explode(F.split(at[1], " ")).alias("word")).filter("word <> ''").select("lang", "word", "zipf")


def pack(words: DataFrame) -> DataFrame:
    """The reverse: (lang, packed) of (lang, word, zipf); bands fall, words rise."""
    bands = words.groupBy("lang", F.round(F.col("zipf") * 10).cast("int").alias("d")).agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("ws"))
    parts = F.sort_array(F.collect_list(F.struct("d", F.concat_ws(":", F.col("d").cast("string"), "ws").alias("s"))), asc=False)
    return bands.groupBy("lang").agg(F.array_join(F.transform(parts, lambda x: x["s"]), ";").alias("packed"))


def from_ngrams(spark: SparkSession, path: str, least: float = 1.0, years_from: int = 1980) -> DataFrame:
    """(word, zipf, tag, capital_share, common) from lines ``word[_TAG] TAB year,count,volumes TAB ...``.

    zipf is log10 of occurrences a thousand million words; tag is the part of speech of most uses; common marks the 2,000 most used.
    """
    lines = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    head = lines.select(F.col("c")[0].alias("head"), F.explode(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(1)))).alias("cell"))
    cell = F.split("cell", ",")
    counts = head.filter(cell[0].cast("int") >= years_from).select(F.regexp_extract("head", r"^(.+?)(?:_([A-Z]+))?$", 1).alias("form"), F.regexp_extract("head", r"^(.+?)(?:_([A-Z]+))?$", 2).alias("tag"), cell[1].cast("long").alias("n"))
    counts = counts.withColumn("word", F.lower("form")).withColumn("capital", F.col("form").rlike(r"^\p{Lu}"))
    tags = counts.filter("tag <> ''").groupBy("word", "tag").agg(F.sum("n").alias("n")).groupBy("word").agg(F.max_by("tag", F.struct("n", "tag")).alias("tag"))
    sums = counts.filter("tag = ''").groupBy("word").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("capital"), F.col("n")).otherwise(0)) / F.sum("n")).alias("capital_share"))
    total = sums.agg(F.sum("n").alias("total"))
    zipf = F.round(F.log10(F.col("n") / F.col("total") * 1e9), 1)
    out = sums.join(F.broadcast(total)).withColumn("zipf", zipf).filter(F.col("zipf") >= least).join(tags, "word", "left")
    top = out.orderBy(F.col("n").desc(), "word").limit(2000).select("word", F.lit(True).alias("common"))
    return out.join(F.broadcast(top), "word", "left").select("word", "zipf", "tag", "capital_share", F.coalesce("common", F.lit(False)).alias("common"))


def stale_packs(local: DataFrame, offered: DataFrame) -> DataFrame:
    """(lang, hash) of the offered packs that aren't held as they are."""
    return offered.select("lang", "hash").join(local.select("lang", "hash"), ["lang", "hash"], "left_anti")

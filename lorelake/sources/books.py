"""Books and chats as files: loaders and scans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema


def _stem(c: str = "_file") -> Column:
    return F.regexp_extract(F.col(c), r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_books(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entries of book documents (JSON, one book a file, or with ``lines`` one a line). A missing world is the book's name, else the file's; uid falls back to its key.

    ``delayUntilRecursion`` may be a boolean or a level; it comes out as a level, 0 without one.
    """
    books = spark.read.schema(schema.BOOK).option("multiLine", not lines).json(path).withColumn("_file", F.input_file_name())
    rows = books.select(F.coalesce("name", F.url_decode(_stem())).alias("_book"), F.explode("entries").alias("_uid", "e")).select("_book", "_uid", "e.*")
    level = F.when(F.col("delayUntilRecursion") == "true", 1).otherwise(F.coalesce(F.expr("try_cast(delayUntilRecursion AS int)"), F.lit(0)))
    out = rows.withColumn("world", F.coalesce("world", "_book")).withColumn("uid", F.coalesce("uid", F.col("_uid").cast("long"))).withColumn("delayUntilRecursion", level)
    return out.withColumn("tier", F.when(F.col("stmemorybooks").isNotNull() | F.col("STMB_start").isNotNull(), "memory").otherwise("reference")).drop("_book", "_uid")


def read_chats(spark: SparkSession, path: str, keep_hidden: bool = False) -> DataFrame:
    """(chat_id, idx, ...message) of chat logs (JSON lines; the first line is metadata). Unreadable lines go; so do hidden and empty messages.

    An attachment's prefix of ``fileLength`` characters is taken off the text. idx is the place in the file: a log is read in splits, lines are
    numbered within a split, and the lines of the splits before are added, so no task holds a whole log.
    """
    at = ["_metadata.file_path", "_metadata.file_block_start"]
    raw = spark.read.text(path).select(*[F.col(c) for c in at], "value", F.monotonically_increasing_id().alias("_row"))
    sizes = raw.groupBy("file_path", "file_block_start").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file_path", "file_block_start", before.alias("_before"))  # one row a split
    local = F.row_number().over(Window.partitionBy("file_path", "file_block_start").orderBy("_row")) - 1
    lines = raw.withColumn("_at", local).join(starts, ["file_path", "file_block_start"]).select(F.url_decode(F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("chat_id"), (F.col("_at") + F.col("_before")).cast("int").alias("line"), "value")
    lines = lines.filter("line > 0 AND trim(value) <> ''")
    parsed = lines.withColumn("m", F.from_json("value", schema.MESSAGE, {"mode": "PERMISSIVE"})).filter(F.col("value").startswith("{") & F.expr("try_parse_json(value) IS NOT NULL"))
    text = F.when(F.col("m.extra.fileLength") > 0, F.substring(F.col("m.mes"), F.col("m.extra.fileLength") + 1, F.length("m.mes"))).otherwise(F.col("m.mes"))
    rows = parsed.select("chat_id", F.col("line").alias("idx"), "m.name", F.coalesce("m.is_user", F.lit(False)).alias("is_user"), F.coalesce("m.is_system", F.lit(False)).alias("is_system"), "m.send_date", text.alias("mes"), "m.swipe_id")
    return rows if keep_hidden else rows.filter(~F.col("is_system") & (F.coalesce("mes", F.lit("")) != ""))


def scan_counts(spark: SparkSession, path: str) -> DataFrame:
    """(scanned, unreadable, hidden): lines of the chat logs by fate."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    j = F.from_json("value", schema.MESSAGE)
    return lines.agg(F.count(F.lit(1)).alias("scanned"), F.sum(F.expr("try_parse_json(value) IS NULL").cast("long")).alias("unreadable"), F.sum(F.coalesce(j["is_system"], F.lit(False)).cast("long")).alias("hidden"))


def read_heads(spark: SparkSession, path: str, most: int = 65_536) -> DataFrame:
    """(path, ...metadata) of the first line of each chat log. Only the head of a file is read: tasks get names, not contents."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote, urlparse

        import pyarrow.fs as pafs

        for b in batches:
            names, lines = b.column("path").to_pylist(), []
            for name in names:
                fs, local = (pafs.LocalFileSystem(), unquote(urlparse(name).path)) if name.startswith("file:") else pafs.FileSystem.from_uri(name)
                with fs.open_input_stream(local) as f:
                    lines.append(f.read(most).split(b"\n", 1)[0].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], names=["path", "value"])

    rows = files.mapInArrow(heads, "path string, value string")
    return rows.select("path", F.from_json("value", schema.CHAT_HEAD).alias("h")).select("path", "h.*")


def write_books(entries: DataFrame, path: str) -> None:
    """Entries as book documents, one JSON line a book, in a folder."""
    fields = [c for c in entries.columns if c != "world"]
    whole = F.map_from_entries(F.collect_list(F.struct(F.col("uid").cast("string"), F.struct(*fields))))
    entries.groupBy("world").agg(whole.alias("entries")).withColumnRenamed("world", "name").write.json(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(collection, files, bytes, newest): collections are the folders of a store; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return files.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("collection")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"))

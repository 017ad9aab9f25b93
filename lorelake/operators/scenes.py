"""Chats, messages, scan windows and the entries they may activate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import parsed_date
from ..session import stored

#: clock order of the messages of a chat; msg_id settles equal or missing times
ORDER = ("t", "msg_id")


def usable_messages(messages: DataFrame) -> DataFrame:
    """Messages that aren't hidden and have text, with their time."""
    return messages.filter(~F.coalesce("is_system", F.lit(False)) & (F.coalesce("mes", F.lit("")) != "")).withColumn("t", F.coalesce(parsed_date(F.col("send_date")), F.lit(0)))


def last_messages(messages: DataFrame, depth: int | None) -> DataFrame:
    """The last ``depth`` usable messages of each chat, numbered back from the newest (0); None takes all, 0 none.

    The rank limit is taken before the shuffle too, so a hot chat sends at most ``depth`` rows a task.
    """
    rows = usable_messages(messages).select("chat_id", "msg_id", "t", "name", "is_user", "mes")
    if depth is None:
        return numbered(rows, "chat_id", list(ORDER))
    w = Window.partitionBy("chat_id").orderBy(*[F.col(c).desc() for c in ORDER])
    return rows.withColumn("back", F.row_number().over(w) - 1).filter(F.col("back") < depth)


def spoken(include_names: bool = True) -> Column:
    """``name: text`` of a message."""
    return F.when(F.lit(include_names) & (F.coalesce("name", F.lit("")) != ""), F.concat_ws(": ", "name", F.coalesce("mes", F.lit("")))).otherwise(F.coalesce("mes", F.lit("")))


def window_segments(messages: DataFrame, depth: int | None = 10, window: str = "paragraph", include_names: bool = True) -> DataFrame:
    """(chat_id, msg_id, back, seg, text): the units of each chat's scan window that a key must match within."""
    rows = last_messages(messages, depth).withColumn("text", spoken(include_names))
    if window == "paragraph":
        return rows.select("chat_id", "msg_id", "back", F.posexplode(T.paragraphs("text")).alias("seg", "text"))
    if window == "message":
        return rows.filter(F.trim("text") != "").select("chat_id", "msg_id", "back", F.lit(0).alias("seg"), "text")
    if depth is None:
        raise ValueError("a scan window needs a depth")
    pieces = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "text"))), lambda x: x["text"])  # at most depth messages a chat
    return rows.groupBy("chat_id").agg(F.min("msg_id").alias("msg_id"), F.array_join(pieces, "\n").alias("text")).select("chat_id", "msg_id", F.lit(0).alias("back"), F.lit(0).alias("seg"), "text")


def query_text(messages: DataFrame, depth: int = 10, include_names: bool = True) -> DataFrame:
    """(chat_id, query): the last trimmed, non-blank messages in order, set apart by empty lines."""
    rows = last_messages(messages.filter(F.trim("mes") != ""), depth).withColumn("mes", F.trim("mes")).withColumn("text", spoken(include_names))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "text"))), lambda x: x["text"])
    return rows.groupBy("chat_id").agg(F.array_join(pieces, "\n\n").alias("query"))


def block_windows(messages: DataFrame, depth: int) -> DataFrame:
    """(chat_id, block, n): tumbling blocks of ``depth`` messages cut from the newest end, the last block full.

    Ranks over a whole chat come from a global sort with counts by partition, so a hot chat isn't ranked in one task.
    """
    rows = usable_messages(messages).select("chat_id", *ORDER)
    return numbered(rows, "chat_id", list(ORDER)).groupBy("chat_id", F.floor(F.col("back") / depth).alias("block")).agg(F.count(F.lit(1)).alias("n"))


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with back, the place of each row in its key counted from the end, without gathering a key in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(key), *[F.col(c).desc() for c in order]]
    # written once: a second run of the sampling, or partitions joined at run time, would give other part numbers
    placed = stored(rows.repartitionByRange(n, *by).withColumn("part", F.spark_partition_id()), "placed")
    local = Window.partitionBy(key, "part").orderBy(*by[1:])
    sizes = placed.groupBy(key, "part").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(key, "part", before.alias("before"))  # at most one row a key and task
    return placed.withColumn("at", F.row_number().over(local) - 1).join(starts, [key, "part"]).withColumn("back", F.col("at") + F.col("before")).drop("part", "at", "before")


def sliding(rows: DataFrame, key: str, order: list[str], depth: int, value: str, out: str, block: int = 10_000) -> DataFrame:
    """``rows`` with out, the values of the last ``depth`` rows of the key up to each row, oldest first.

    A key is cut into blocks of ``block`` rows; a block also gets the depth - 1 rows before it, so no task holds more than that of any key.
    """
    placed = numbered(rows, key, order)
    own = F.floor(F.col("back") / block)
    also = F.when((F.col("back") % block < depth - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    spread = placed.withColumn("_own", own).withColumn("_block", F.explode(also))
    w = Window.partitionBy(key, "_block").orderBy(F.col("back").desc()).rowsBetween(-(depth - 1), 0)
    return spread.withColumn(out, F.collect_list(value).over(w)).filter("_own = _block").drop("_own", "_block", "back")


def eligible(entries: DataFrame) -> DataFrame:
    """Enabled entries with content."""
    return entries.filter(~F.coalesce("disable", F.lit(False)) & (F.trim(F.coalesce("content", F.lit(""))) != ""))


def current_entries(entries: DataFrame) -> DataFrame:
    """Of the copies of (world, uid) the one stored last."""
    newest = entries.groupBy("world", "uid").agg(F.max(F.struct("saved_at", "entry_id")).entry_id.alias("entry_id"))
    return entries.join(newest.select("entry_id"), "entry_id", "left_semi")


# The flags by which an entry asks to be matched against a source beside the chat.
SOURCE_FLAGS = {"match_persona_description": "persona", "match_character_description": "description", "match_character_personality": "personality", "match_character_depth_prompt": "depth_prompt", "match_scenario": "scenario", "match_creator_notes": "creator_notes"}


def used_sources(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """The sources (chat_id, world, source, text) that some entry of the book asks for."""
    have = [c for c in SOURCE_FLAGS if c in entries.columns]
    asked = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(False)), SOURCE_FLAGS[c]) for c in have])) if have else F.array().cast("array<string>")
    wanted = entries.select("world", F.explode(asked).alias("source")).distinct()
    return sources.filter(F.coalesce("text", F.lit("")) != "").join(wanted, ["world", "source"], "left_semi")


def source_segments(sources: DataFrame, entries: DataFrame, window: str = "paragraph") -> DataFrame:
    """(seg_id, chat_id, world, source, text): the used sources as segments of their own, never a continuation of a message."""
    used = used_sources(sources, entries)
    cut = used.select("chat_id", "world", "source", F.posexplode(T.paragraphs("text")).alias("seg", "text")) if window == "paragraph" else used.withColumn("seg", F.lit(0))
    return cut.select(F.concat_ws("/", F.lit("s"), "chat_id", "source", "seg").alias("seg_id"), "chat_id", "world", "source", "text")

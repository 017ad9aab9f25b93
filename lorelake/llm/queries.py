"""Queries of the llm operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scenes
from ..session import stored, table
from . import bpe, chunk_tree, consensus, conversations, distinctive, forms, leakage, markup, residue, terms

COMMON = {"mes": 0.20, "key": 0.02}


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(terms.records(table(spark, d, "book_entries"), table(spark, d, "chat_messages")), COMMON)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_counts(spark, d).filter(F.col("mark").isNotNull()).select("field", "term", "mark")


def p2_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "graded_entries"), table(spark, d, "scene_raters"))


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(table(spark, d, "graded_entries"), table(spark, d, "scene_raters"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_consensus(spark, d).filter("disputed AND n_raters >= 3").select("item_id", "grade")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    return forms.consistent_values(table(spark, d, "book_entries"), table(spark, d, "chat_messages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return forms.inconsistent_values(table(spark, d, "book_entries"), table(spark, d, "chat_messages"))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_texts(table(spark, d, "chat_messages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.present_markups(table(spark, d, "chat_messages"))


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversation_rows(table(spark, d, "chats"), table(spark, d, "chat_messages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversation_faults(table(spark, d, "chats"), table(spark, d, "chat_messages"))


def p5_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of all message rows from reply links alone, their chat_id hidden: the k-th message of a chat by msg_id answers the (k/2)-th."""
    rows = table(spark, d, "chat_messages").filter("chat_id IS NOT NULL").select("chat_id", "msg_id")
    placed = stored(scenes.numbered(rows, "chat_id", ["msg_id"]), "placed")
    above = placed.select("chat_id", F.col("back").alias("up"), F.col("msg_id").alias("reply_to"))
    replies = placed.filter("back > 0").withColumn("up", F.floor((F.col("back") - 1) / 2)).join(above, ["chat_id", "up"]).select("msg_id", "reply_to")
    hidden = rows.select("msg_id", F.lit(None).cast("string").alias("chat_id"))
    return conversations.assign_conversations(hidden, replies, quotes=False).groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"), F.max("msg_id").alias("last_msg"))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "book_entries").select(F.col("entry_id").alias("row_id"), F.col("content").alias("text"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunk_tree.split_items(_contents(spark, d)).withColumnRenamed("row_id", "entry_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return chunk_tree.split_levels(_contents(spark, d)).withColumnRenamed("row_id", "entry_id")


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.term_scores(distinctive.records(table(spark, d, "book_entries"), table(spark, d, "chat_messages")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    recs = distinctive.records(table(spark, d, "book_entries"), table(spark, d, "chat_messages"))
    return distinctive.term_scores(recs, min_tf=3, max_df=5).select("field", "row_id", "term")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_passages(spark, d).select("doc_id", "item_id")


def p10_judged(spark: SparkSession, d: str) -> DataFrame:
    return residue.judged(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_judged(spark, d).filter("residue").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:].split("_")[0].isdigit()}


_DATE = """CASE WHEN regexp_full_match(trim(send_date), '\\d{12,14}') THEN try_cast(trim(send_date) AS BIGINT) * 1000
  WHEN regexp_full_match(trim(send_date), '\\d{9,10}') THEN try_cast(trim(send_date) AS BIGINT) * 1000000
  ELSE epoch_us(coalesce(try_strptime(trim(send_date), '%Y-%m-%dT%H:%M:%S.%gZ'), try_strptime(trim(send_date), '%Y-%m-%d@%Hh%Mm%Ss'), try_strptime(trim(send_date), '%B %-d, %Y %-I:%M%p'))) END"""


def oracle_sql() -> dict[str, str]:
    said = f"SELECT DISTINCT ON (chat_id, name, is_user, is_system, send_date, mes) chat_id, msg_id, name, is_user, mes, {_DATE} AS t FROM chat_messages WHERE is_system IS NOT TRUE AND regexp_matches(mes, '\\S') ORDER BY chat_id, name, is_user, is_system, send_date, mes, msg_id"
    units = lambda split: f"len(list_filter({split}, lambda u: length(trim(u, E' \\t\\r\\n')) > 1200)) = 0"
    faults = f"""WITH m AS (SELECT DISTINCT chat_id, name, is_user, is_system, send_date, mes, {_DATE} AS t FROM chat_messages
            WHERE is_system IS NOT TRUE AND regexp_matches(mes, '\\S')),
          o AS (SELECT chat_id, is_user, t, lead(is_user) OVER (PARTITION BY chat_id ORDER BY t, is_user DESC) AS following FROM m),
          g AS (SELECT chat_id, count(*) AS n, bool_or(is_user IS NULL OR t IS NULL) AS broken, count(*) FILTER (is_user) AS u, count(*) FILTER (NOT is_user) AS c,
            bool_or(is_user AND coalesce(following, true)) AS open FROM o GROUP BY chat_id),
          f AS (SELECT chat_id, CASE WHEN n IS NULL THEN 'empty' WHEN broken THEN 'broken' WHEN u = 0 OR c = 0 THEN 'one_sided' WHEN open THEN 'unanswered' END AS fault FROM chats LEFT JOIN g USING (chat_id))
          SELECT chat_id, fault FROM f WHERE fault IS NOT NULL"""
    return {
        "p5_found": faults,
        "p5_rows": f"""SELECT s.chat_id, make_timestamp(t) AS t, msg_id, CASE WHEN is_user THEN 'user' ELSE 'assistant' END AS role, name, mes FROM ({said}) s
          JOIN chats USING (chat_id) WHERE s.chat_id NOT IN (SELECT chat_id FROM ({faults}))""",
        "p5_rebuilt": "SELECT 'component-' || min(msg_id) AS chat_id, count(*) AS n, max(msg_id) AS last_msg FROM chat_messages WHERE chat_id IS NOT NULL GROUP BY chat_messages.chat_id",
        "p6_found": f"""SELECT entry_id, CASE WHEN {units("regexp_split_to_array(content, '\\n[ \\t\\r]*\\n')")} THEN 'paragraph' WHEN {units("string_split(content, chr(10))")} THEN 'line'
            WHEN {units("string_split(regexp_replace(content, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10))")} THEN 'sentence'
            WHEN {units("regexp_split_to_array(content, '[ \\t\\r\\n]+')")} THEN 'word' ELSE 'none' END AS level
          FROM book_entries WHERE length(content) > 1200""",
    }

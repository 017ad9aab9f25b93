"""Rebuilding conversations from message rows.

``assign_conversations`` gives messages without an identifier one: connected components over reply and quote links, by
alternating large-star and small-star joins. ``conversation_rows`` orders the messages of each conversation;
``conversation_faults`` names the first fault of each chat.

No step gathers a conversation in one task: rows are range-partitioned by (chat, time, tie), so a conversation that holds
a third of all rows is spread over many tasks; each task sums up its stretch of a conversation in one row, and these few
rows (at most one a chat and task boundary) are folded in order.

Defined results: rows alike in name, is_user, is_system, send_date and text are one message; hidden rows and null or blank
texts are left out; a null is_user or an unreadable send_date makes a chat broken; equal times are ordered user first, then by content hash; an empty
message table makes every chat empty; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parsed_date
from ..session import stored
from .terms import counted_messages


def small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(lowest, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest node of its neighbourhood, itself included."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")  # small_star takes out what stands twice


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for edges (u, v) of longs; the component is its smallest node.

    Large-star and small-star alternate until the edge set no longer changes; both keep the number of edges from growing
    past that of the nodes' links, and a hub's edges are spread by the shuffle over their larger end.
    """
    now = stored(edges.filter("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        now = stored(small_star(large_star(now)), "stars", instead=now)
        after = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        if mark == after:
            break
        mark = after
    else:
        raise RuntimeError("the components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def quote_links(messages: DataFrame) -> DataFrame:
    """(u, v) message ids: a text whose opening lines, marked ``> ``, repeat another message as a whole.

    A quote of less than 20 characters counts where just one message has that text: ``> yes`` names no message if many say yes.
    """
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    quoted = bare(F.regexp_replace(F.regexp_extract("mes", r"^((?:> ?[^\n]*(?:\n|$))+)", 1), r"(?m)^> ?", ""))
    quotes = messages.select(F.col("msg_id").alias("u"), F.md5(quoted).alias("h"), F.length(quoted).alias("n")).filter("n > 0")
    texts = messages.groupBy(F.md5(bare(F.col("mes"))).alias("h")).agg(F.min("msg_id").alias("v"), F.count(F.lit(1)).alias("copies"))  # copies of a text are one target
    return quotes.join(texts, "h").filter("u <> v AND (n >= 20 OR copies = 1)").select("u", "v")


def assign_conversations(messages: DataFrame, replies: DataFrame | None = None, quotes: bool = True) -> DataFrame:
    """``messages`` with chat_id filled: a message without one takes that of its component, or ``component-<smallest msg_id>``.

    Links are quotes (unless ``quotes`` is off) and, if given, ``replies`` (msg_id, reply_to). Only components with a message that lacks an identifier
    are looked at; a known chat_id is never replaced. If a component touches several chats, the smallest chat_id counts.
    """
    if not messages.filter(F.col("chat_id").isNull()).limit(1).count():
        return messages
    links = quote_links(messages) if quotes or replies is None else messages.select(F.col("msg_id").alias("u"), F.col("msg_id").alias("v")).limit(0)
    if replies is not None:
        links = links.unionByName(replies.select(F.col("msg_id").alias("u"), F.col("reply_to").alias("v")).dropna())
    lacking = messages.filter(F.col("chat_id").isNull()).select(F.col("msg_id").alias("node"))
    # known messages end a path: one side of each link lacks its identifier, so two chats are never joined through known rows alone
    ends = links.join(lacking.withColumnRenamed("node", "u"), "u", "left_semi").unionByName(links.join(lacking.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v"))
    loops = lacking.select(F.col("node").alias("node"), F.col("node").alias("component"))
    found = components(ends)
    groups = found.unionByName(loops.join(found.select("node"), "node", "left_anti"))
    known = groups.join(messages.filter(F.col("chat_id").isNotNull()).select(F.col("msg_id").alias("node"), "chat_id"), "node").groupBy("component").agg(F.min("chat_id").alias("known_chat"))
    names = groups.join(known, "component", "left").select(F.col("node").alias("msg_id"), F.coalesce("known_chat", F.concat(F.lit("component-"), F.col("component").cast("string"))).alias("found_chat"))
    rest = messages.filter(F.col("chat_id").isNotNull())
    given = messages.filter(F.col("chat_id").isNull()).join(names, "msg_id", "left")
    return rest.unionByName(given.withColumn("chat_id", F.col("found_chat")).select(*messages.columns))


def _conversations(chats: DataFrame, messages: DataFrame, replies: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The messages with their conversations, and (chat_id) of all conversations to judge: the chats and the components without a known chat."""
    known = assign_conversations(messages, replies)
    if known is messages:
        return messages, chats.select("chat_id")
    known = stored(known, "assigned")
    rebuilt = known.select("chat_id").dropna().distinct().join(messages.select("chat_id").dropna().distinct(), "chat_id", "left_anti")
    return known, chats.select("chat_id").unionByName(rebuilt.join(chats.select("chat_id"), "chat_id", "left_anti"))


def _said(messages: DataFrame) -> DataFrame:
    """(chat_id, t, is_user, sig) and the columns kept: the rows that count, sig alike for copies of one message."""
    same = F.struct(F.unhex(F.md5(F.to_json(F.struct("name", "is_user", "is_system", "send_date", "mes")))).alias("m")).m
    return counted_messages(messages).withColumn("sig", same).withColumn("t", parsed_date(F.col("send_date")))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, one row for each chat of this task out; state carries over the batches."""
    names = ["chat_id", "n", "broken", "users", "characters", "first_t", "first_user", "last_user", "open_user"]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    chat, state, last, rows = None, None, None, []

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    for b in batches:
        for c, t, user, sig in zip(*(b.column(k).to_pylist() for k in ("chat_id", "t", "is_user", "sig"))):
            if c == chat and (t, user, sig) == last:
                continue
            if c != chat:
                if state:
                    rows.append((chat, *state))
                chat, state = c, [0, 0, 0, 0, t, user, user, False]
            elif state[6] and user is not False:
                state[7] = True  # a user message whose next one is not the character's
            last = (t, user, sig)
            state[0] += 1
            state[1] += t is None or user is None
            state[2] += user is True
            state[3] += user is False
            state[6] = user
        if len(rows) > 50_000:
            yield out()
            rows = []
    if state:
        rows.append((chat, *state))
    yield out()


def conversation_faults(chats: DataFrame, messages: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """(chat_id, fault) of the conversations that aren't sound; fault is empty, broken, one_sided or unanswered, the first that holds.

    Conversations are the chats and the components that touch no known chat.
    """
    known, ids = _conversations(chats, messages, replies)
    return _faults(ids, known)


def _faults(chats: DataFrame, messages: DataFrame) -> DataFrame:
    said = _said(messages).select("chat_id", "t", "is_user", "sig")
    order = [F.col("chat_id"), F.col("t"), F.col("is_user").desc(), F.col("sig")]
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = said.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        _stretches, "chat_id string, n long, broken long, users long, characters long, first_t long, first_user boolean, last_user boolean, open_user boolean"
    )
    # the stretches of a chat are as many as the tasks it was spread over; in order of time the end of each meets the start of the next
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("first_t", F.lit(-(2**62))).alias("t"), (~F.coalesce("first_user", F.lit(False))).alias("c"), "first_user", "last_user")))
    folded = parts.groupBy("chat_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "broken", "users", "characters")], F.max("open_user").alias("inside"), ordered.alias("s")
    )
    across = F.exists(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.get("s", i).last_user & F.coalesce(F.get("s", i + 1).first_user, F.lit(True)))
    across = F.when(F.size("s") > 1, across).otherwise(F.lit(False))
    ends_open = F.coalesce(F.element_at("s", -1).last_user, F.lit(False))
    fault = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "empty")
        .when(F.col("broken") > 0, "broken")
        .when((F.col("users") == 0) | (F.col("characters") == 0), "one_sided")
        .when(F.col("inside") | across | ends_open, "unanswered")
    )
    return chats.select("chat_id").join(folded, "chat_id", "left").select("chat_id", fault.alias("fault")).filter(F.col("fault").isNotNull())


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for b in batches:
        keep = np.ones(b.num_rows, bool)
        for i, row in enumerate(zip(*(b.column(k).to_pylist() for k in ("chat_id", "t", "is_user", "sig")))):
            keep[i] = row != last
            last = row
        yield b.filter(pa.array(keep)).select(["chat_id", "t", "msg_id", "is_user", "name", "mes"])


def conversation_rows(chats: DataFrame, messages: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """The messages of the sound conversations as (chat_id, t, msg_id, role, name, mes), copies dropped, in time order within a chat.

    The result is range-partitioned and sorted by chat and time, so it can be written as it is; msg_id breaks no order, as t,
    role and content hash settle it.
    """
    known, ids = _conversations(chats, messages, replies)
    sound = ids.join(_faults(ids, known), "chat_id", "left_anti")
    said = _said(known).join(sound, "chat_id", "left_semi").select("chat_id", "t", "is_user", "sig", "msg_id", "name", "mes")
    order = [F.col("chat_id"), F.col("t"), F.col("is_user").desc(), F.col("sig")]
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = said.repartitionByRange(n, *order).sortWithinPartitions(*order, "msg_id").mapInArrow(_turns, "chat_id string, t long, msg_id long, is_user boolean, name string, mes string")
    return rows.select("chat_id", F.timestamp_micros("t").alias("t"), "msg_id", F.when(F.col("is_user"), "user").otherwise("assistant").alias("role"), "name", "mes")

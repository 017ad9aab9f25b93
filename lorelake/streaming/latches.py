"""First-firing state of entries over a stream of messages, on the clock of the chat's length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scenes import sliding

OUTPUT = "chat_id string, entry_id long, at int, state string"
STATE = "first int, end int"


def latch_function(sticky: int = 0, cooldown: int = 0) -> Callable:
    """Per (chat, entry): the first length it fired at, and whether it is still held in ``sticky`` messages later (0: for good).

    With a cooldown it is ``cooling`` for so many messages more, and then fires anew. A length below the first firing is a rewind: the latch is
    undone and the firing counts anew.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, end = state.get if state.exists else (None, None)
        rows = []
        for pdf in batches:
            for at in sorted(pdf["at"].tolist()):
                if first is None or at < first or (cooldown and at > end + cooldown):
                    first, end = at, at + sticky if sticky else 2**31 - 1
                    rows.append((key[0], key[1], at, "fired"))
                else:
                    rows.append((key[0], key[1], at, "held" if at <= end else "cooling" if cooldown else "free"))
        if first is not None:
            state.update((int(first), int(end)))
        yield pd.DataFrame(rows, columns=["chat_id", "entry_id", "at", "state"])

    return update


def latch_stream(firings: DataFrame, sticky: int = 0, cooldown: int = 0) -> DataFrame:
    """(chat_id, entry_id, at, state) of a stream of firings (chat_id, entry_id, at)."""
    return firings.groupBy("chat_id", "entry_id").applyInPandasWithState(latch_function(sticky, cooldown), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def first_firings(firings: DataFrame, up_to: str | None = None) -> DataFrame:
    """The same in batch: (chat_id, entry_id, at), firings after ``up_to`` left out."""
    rows = firings.filter(F.col("at") <= F.col(up_to)) if up_to else firings
    return rows.groupBy("chat_id", "entry_id").agg(F.min("at").alias("at"))


def timed_windows(events: DataFrame, size: str, late: str, slide: str | None = None) -> DataFrame:
    """(window, event_type, n, total) of a stream of events with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events no further apart than the gap."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def turn_windows(messages: DataFrame, depth: int) -> DataFrame:
    """``messages`` with said, the texts of the last ``depth`` messages up to each one: a sliding window by count."""
    return sliding(messages, "chat_id", ["t", "msg_id"], depth, "mes", "said")

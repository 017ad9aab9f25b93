import datetime as dt

import pytest

ENTRY = "entry_id long, world string, uid long, key array<string>, keysecondary array<string>, comment string, content string, constant boolean, vectorized boolean, disable boolean, selective_logic int, wi_position int, entry_group string, saved_at timestamp, field string, term string, row_id long, chunk string"
MESSAGE = "msg_id long, chat_id string, name string, is_user boolean, is_system boolean, send_date string, mes string, swipe_id int, loaded_at timestamp, field string, text string, t long, sig string, block string, row_id long"
NOW = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="session")
def make_entries(spark):
    """Entries from (entry_id, key, content); further columns carry names that the operators use themselves."""

    def make(rows):
        full = [(i, "w", i, k, [], None, c, False, False, False, 0, 0, None, NOW, "clash", "clash", -1, "clash") for i, k, c in rows]
        return spark.createDataFrame(full, ENTRY)

    return make


@pytest.fixture(scope="session")
def make_messages(spark):
    """Messages from (msg_id, chat_id, is_user, is_system, send_date, mes)."""

    def make(rows):
        full = [(i, c, "A" if u else "B", u, s, d, m, 0, NOW, "clash", "clash", -1, "clash", "clash", -1) for i, c, u, s, d, m in rows]
        return spark.createDataFrame(full, MESSAGE)

    return make

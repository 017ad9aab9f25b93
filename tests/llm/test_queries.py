"""The llm queries on the smallest tables: against their SQL, or for the columns they must have."""

import pytest

from lorelake.llm import queries as Q

from ..compare import DATA, assert_like_sql, duck_views, no_tables

pytestmark = no_tables
COLUMNS = {
    "p1_found": {"field", "term", "mark"}, "p2_found": {"item_id", "grade"}, "p3_found": {"field", "row_id"}, "p4_found": {"msg_id", "markup"}, "p5_found": {"chat_id", "fault"},
    "p6_found": {"entry_id", "level"}, "p7_found": {"field", "row_id", "term"}, "p8_ids": {"doc_id", "ids"}, "p9_found": {"doc_id", "item_id"}, "p10_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_like_sql(spark, name):
    assert_like_sql(Q.queries()[name](spark, DATA), duck_views(DATA), Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_columns(spark, name):
    df = Q.queries()[name](spark, DATA)
    rows = df.collect()
    assert rows and set(df.columns) >= COLUMNS.get(name, set()) and (name not in COLUMNS or set(df.columns) == COLUMNS[name])
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)

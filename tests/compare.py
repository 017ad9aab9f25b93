"""Comparison of a query's rows with those of its SQL."""

import math
import os

import pytest

DATA = os.environ.get("LORELAKE_TESTDATA", "/root/testdata/sf0.001")
no_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def duck_views(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def plain(v):
    return round(float(v), 5) if isinstance(v, float) and not math.isnan(v) else float(v) if hasattr(v, "as_tuple") else repr(v)


def assert_like_sql(df, duck, sql):
    rows, cols = df.collect(), sorted(df.columns)
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in rows) == want

"""Hashes, groups, timed effects, widening, match sources, and the session's folder, on small tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lorelake import session
from lorelake.functions import hashing
from lorelake.operators import activation, audit, delivery, evaluation, lexical, lineage, scenes, suggest
from lorelake.sources import books
from lorelake.streaming import latches


def test_known_hashes(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",), ("é😀",), (None,)], "s string")
    got = {r.s: (r.f, r.d) for r in rows.select("s", hashing.fnv1a(F.col("s")).alias("f"), hashing.djb2(F.col("s")).alias("d")).collect()}
    assert got[""] == (0x811C9DC5, 5381) and got["a"] == (0xE40C292C, 177670) and got["foobar"][0] == 0xBF9CF968 and got[None] == (None, None)
    h = 5381
    for u in (0xE9, 0xD83D, 0xDE00):
        h = (h * 33 + u) & 0xFFFFFFFF
    assert got["é😀"][1] == h


def test_canonical_json(spark):
    df = spark.createDataFrame([((2, None, [(1, "x")]),)], "s struct<b:int,a:string,c:array<struct<z:int,y:string>>>")
    out = df.select(hashing.canonical_json(F.col("s"), df.schema["s"].dataType)).first()[0]
    assert out == '{"a":null,"b":2,"c":[{"y":"x","z":1}]}'


def test_index_fingerprint_ignores_order(spark):
    rows = [("w", 1, "one", False), ("w", 2, "two", None), ("w", 3, "off", True), ("w", 4, " ", None), ("w", 5, None, None)]
    of = lambda rs: lineage.index_fingerprints(spark.createDataFrame(rs, "world string, uid long, content string, disable boolean")).first().fingerprint
    assert of(rows) == of(rows[::-1]) and of(rows).startswith("2:6:") and of(rows) != of([("w", 1, "two", False), ("w", 2, "one", None)])


def test_groups(spark):
    cols = "chat_id string, entry_id long, entry_group string, sticky boolean, group_override boolean, `order` int, group_scoring boolean, score double, group_weight double"
    rows = [("c", 1, "g", None, None, 9, None, 5.0, 1.0), ("c", 2, "g", True, None, 0, None, 0.0, 1.0), ("c", 3, "h", None, True, 1, None, 0.0, 1.0), ("c", 4, "h", None, True, 7, None, 0.0, 1.0), ("c", 5, "h", None, None, 99, None, 0.0, 1.0),
            ("c", 6, "k", None, None, None, True, 1.0, None), ("c", 7, "k", None, None, None, True, 2.0, None), ("c", 8, None, None, None, None, None, None, None), ("c", 9, "", None, None, None, None, None, None)]
    assert sorted(r.entry_id for r in activation.group_winners(spark.createDataFrame(rows, cols)).collect()) == [2, 4, 7, 8, 9]
    drawn = [(f"c{i}", j, "g", None, None, None, None, None, 3.0 if j else 1.0) for i in range(2000) for j in (0, 1)]
    share = sum(r.entry_id for r in activation.group_winners(spark.createDataFrame(drawn, cols)).collect()) / 2000
    assert abs(share - 0.75) < 0.04
    assert activation.group_winners(spark.createDataFrame([], cols)).count() == 0


def test_probabilities_repeat(spark):
    rows = spark.createDataFrame([("c", i, 30.0, None) for i in range(3000)] + [("d", 1, None, None), ("d", 2, 0.0, True), ("d", 3, 0.0, False)], "chat_id string, entry_id long, probability double, sticky boolean")
    one, two = ({(r.chat_id, r.entry_id) for r in activation.probable(rows, s).collect()} for s in (1, 1))
    assert one == two and abs(len(one) / 3000 - 0.3) < 0.03 and {x for x in one if x[0] == "d"} == {("d", 1), ("d", 2)}


def test_timed_states(spark):
    rows = [(5, 3, 2, 0, n) for n in (5, 6, 7, 8, 9, 10)] + [(None, 3, 2, 0, 9), (5, None, 2, None, 6), (1, 0, 0, 20, 9)]
    df = spark.createDataFrame(rows, "at int, sticky int, cooldown int, delay int, length int")
    state = activation.timed_state(*map(F.col, ("at", "sticky", "cooldown", "delay", "length")))
    assert [r.s for r in df.select(state.alias("s")).collect()] == [None, "sticky", "sticky", "cooldown", "cooldown", None, None, "cooldown", "delayed"]


def test_latch_cooldown():
    import pandas as pd

    class State:
        exists = False

        def update(self, v):
            self.exists, self.get = True, v

    out = list(latches.latch_function(2, 3)(("c", 1), iter([pd.DataFrame({"at": [1, 3, 4, 6, 7, 20]})]), State()))[0]
    assert out["state"].tolist() == ["fired", "held", "cooling", "cooling", "fired", "fired"]


def test_widening(spark):
    entries = spark.createDataFrame([(i, "w", [k], [], 0, "", None, None) for i, k in enumerate(["amber", "birch", "cedar", "dahlia"])], "entry_id long, world string, key array<string>, keysecondary array<string>, selective_logic int, content string, constant boolean, disable boolean")
    texts = ["amber", "nothing", "birch", "cedar", "dahlia"]
    segs = spark.createDataFrame([(f"{c}{n}", "w", t, n) for c in "cd" for n, t in enumerate(texts if c == "c" else texts[::-1])], "seg_id string, world string, text string, back int")
    scene = segs.select("seg_id", F.substring("seg_id", 1, 1).alias("chat_id"))
    at = lambda least, depth, most: {(r.chat_id, r.entry_id, r.depth) for r in activation.widened(entries, segs, scene, least, depth, most).collect()}
    assert at(1, 1, 5) == {("c", 0, 1), ("d", 3, 1)}
    assert at(2, 1, 5) == {("c", 0, 3), ("c", 1, 3), ("d", 3, 2), ("d", 2, 2)}
    assert at(9, 1, 2) == {("c", 0, 2), ("d", 3, 2), ("d", 2, 2)}


def test_match_sources(spark):
    entries = spark.createDataFrame([("w", True, None), ("v", None, False)], "world string, match_scenario boolean, match_creator_notes boolean")
    src = spark.createDataFrame([("c", "w", "scenario", "one\n\ntwo"), ("c", "w", "creator_notes", "x"), ("d", "v", "scenario", "y"), ("e", "w", "scenario", None)], "chat_id string, world string, source string, text string")
    assert sorted((r.seg_id, r.text) for r in scenes.source_segments(src, entries).collect()) == [("s/c/scenario/0", "one"), ("s/c/scenario/1", "two")]
    assert scenes.source_segments(src, entries.drop("match_scenario", "match_creator_notes")).count() == 0


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "arm string, p double")
    assert {r.arm: r.p_holm for r in evaluation.holm(rows).collect()} == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.5})


def test_small_orders_and_scopes(spark):
    rows = spark.createDataFrame([("s", 1, "constant", 1), ("s", 2, "dynamic", 2), ("s", 3, "sticky", 0), ("s", 4, "promoted", 1), ("s", 5, None, 0)], "scene string, entry_id long, block string, r int")
    assert [r.entry_id for r in delivery.grade_order(rows, "r").orderBy("place").collect()] == [5, 4, 2, 3, 1]
    e = spark.createDataFrame([(1, True, None, None), (2, None, True, None), (3, None, None, None), (4, None, None, True)], "entry_id long, constant boolean, vectorized boolean, disable boolean")
    ids = lambda **k: sorted(r.entry_id for r in audit.in_scope(e, **k).collect())
    assert ids() == [2, 3] and ids(constant=True, inactive=True) == [1, 2, 3, 4] and ids(keyword=False, vectorized=False) == []
    keys = spark.createDataFrame([("gate of the moon",), ("The Gate",), ("of",), ("",)], "k string")
    assert [r.t for r in keys.select(audit.titled(F.col("k")).alias("t")).collect()] == ["Gate of the Moon", None, "Of", None]


def test_lost_grams():
    rows = [("red gate keeper", 2, 3, True), ("red gate", 2, 2, True), ("gate keeper", 3, 2, True), ("red", 2, 1, True), ("old iron door", 1, 3, False), ("iron door", 1, 2, True)]
    assert suggest.lost_grams(rows) == {"red gate", "old iron door"}


def test_long_logs_are_numbered_over_splits(spark, tmp_path):
    for chat in ("one", "two"):
        lines = [json.dumps({"chat_metadata": {}})] + [json.dumps({"name": "A", "is_user": True, "is_system": False, "mes": f"{chat} {i} " + "x" * 50}) for i in range(2000)]
        (tmp_path / f"{chat}.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        rows = books.read_chats(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 4000 and all(r.mes.startswith(f"{r.chat_id} {r.idx - 1} ") for r in rows)


def test_stored_files_are_deleted(spark):
    one = session.stored(spark.range(3), "a")
    two = session.stored(one.select((F.col("id") + 1).alias("id")), "b", instead=one)
    local = lambda df: df._stored_at.removeprefix("file://")
    assert not os.path.exists(local(one)) and os.path.exists(local(two)) and two.count() == 3
    session.dropped(two)
    assert not os.path.exists(local(two))


def test_spread(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    counted = df.groupBy("id").count()
    assert session.spread(counted) is counted and session.spread(spark.range(0, 10, 1, 64)).count() == 10


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Session:
        conf = Conf()
        sparkContext = object()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())


def test_driver_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert {"chat_id", "entry_id", "prompt_order"} <= set(entry.entry(spark).columns)


def test_top_documents(spark, monkeypatch):
    texts = ["amber birch amber", "birch cedar", "amber", None, "", "cedar cedar cedar birch", "amber"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, term string")
    asked = spark.createDataFrame([(1, "amber"), (1, "cedar"), (2, "birch"), (2, "birch"), (3, "unsaid"), (4, None)], "item_id long, term string")
    whole = {(r.item_id, r.doc_id): r.score for r in lexical.bm25(asked.dropna(), docs, "doc_id", "item_id").collect()}
    want = {}
    for q in (1, 2):
        order = sorted((-round(s, 5), d) for (i, d), s in whole.items() if i == q)[:3]
        want |= {(q, d): (pytest.approx(-s, abs=2e-5), n) for n, (s, d) in enumerate(order, 1)}
    for rows in (200_000, 2):
        monkeypatch.setattr(lexical, "QUERY_ROWS", rows)
        assert {(r.item_id, r.doc_id): (r.score, r.rank) for r in lexical.bm25_top(asked, docs, "doc_id", "item_id", 3).collect()} == want
    assert lexical.bm25_top(asked.limit(0), docs, "doc_id", "item_id", 3).count() == 0 and lexical.bm25_top(asked, docs.limit(0), "doc_id", "item_id", 3).count() == 0

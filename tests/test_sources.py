import datetime as dt
import json

import pandas as pd

from lorelake.operators import matching
from lorelake.sources import books, bundles, index, lexicon
from lorelake.streaming import latches, maintain


def test_books(spark, tmp_path):
    doc = {"entries": {"3": {"key": ["a"], "content": "x", "delayUntilRecursion": True}, "4": {"uid": 9, "world": "other", "stmemorybooks": True, "delayUntilRecursion": 2}}}
    (tmp_path / "My Book.json").write_text(json.dumps(doc))
    rows = {r.uid: r for r in books.read_books(spark, str(tmp_path)).collect()}
    assert rows[3].world == "My Book" and rows[3].delayUntilRecursion == 1 and rows[3].tier == "reference" and rows[9].world == "other" and rows[9].tier == "memory" and rows[9].delayUntilRecursion == 2
    books.write_books(books.read_books(spark, str(tmp_path)).select("world", "uid", "key", "content"), str(tmp_path / "out"))
    assert books.read_books(spark, str(tmp_path / "out")).count() == 2 or spark.read.json(str(tmp_path / "out")).count() == 2


def test_chats(spark, tmp_path):
    lines = [{"user_name": "U", "chat_metadata": {"world_info": "w"}}, {"name": "U", "is_user": True, "mes": "hello"}, {"name": "C", "mes": "PREFIXtext", "extra": {"fileLength": 6}}, {"name": "C", "is_system": True, "mes": "hidden"}, {"name": "C", "mes": ""}]
    (tmp_path / "chat 1.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken", ""]))
    rows = books.read_chats(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.chat_id, r.idx, r.mes) for r in rows] == [("chat 1", 1, "hello"), ("chat 1", 2, "text")]
    head = books.read_heads(spark, str(tmp_path)).first()
    assert head.user_name == "U" and head.chat_metadata.world_info == "w"
    c = books.scan_counts(spark, str(tmp_path)).first()
    assert (c.scanned, c.unreadable, c.hidden) == (6, 1, 1)
    assert books.listing(spark, str(tmp_path)).first().files == 1


def test_bundles_round_trip(spark, tmp_path):
    g = "array<struct<rater:int,grade:int,graded_at:string,why:string>>"
    items = spark.createDataFrame([("c", "s", "b", 1, "t", [(0, 3, "x", None)]), ("c", "s", "b", 2, "t", [])], f"capture_id string, scene_id string, book string, uid long, title string, grades {g}")
    raters = spark.createDataFrame([("c", 1, "llm", "r1", None, None, None), ("c", 0, "human", "r0", None, None, None)], "capture_id string, rater int, kind string, rater_id string, model_name string, family string, quant string")
    bundles.build_bundles(items, raters).write.json(str(tmp_path / "b"))
    back = spark.read.schema(bundles.schema.BUNDLE).json(str(tmp_path / "b"))
    assert sorted((r.uid, len(r.grades)) for r in bundles.candidates(back).collect()) == [(1, 1), (2, 0)]
    assert sorted((r.rater, r.rater_id) for r in bundles.bundle_raters(back).collect()) == [(0, "r0"), (1, "r1")]
    h = lambda rows: {r.world: r.hash for r in bundles.book_hashes(spark.createDataFrame(rows, "world string, uid long, content string")).collect()}
    assert h([("a", 1, "x"), ("a", 2, "y")]) == h([("a", 2, "y"), ("a", 1, "x")]) != h([("a", 1, "y"), ("a", 2, "x")])


def test_lexicon(spark, tmp_path):
    words = spark.createDataFrame([("en", "the", 7.5), ("en", "gate", 4.1), ("en", "barn", 4.1)], "lang string, word string, zipf double")
    packed = lexicon.pack(words)
    assert packed.first().packed == "75:the;41:barn gate" and sorted(map(tuple, lexicon.unpack(packed).collect())) == sorted(map(tuple, words.collect()))
    (tmp_path / "g.tsv").write_text("gate\t1990,50,1\t2000,50,1\nGate\t2000,100,1\ngate_NOUN\t2000,150,1\ngate_VERB\t2000,20,1\nold\t1900,9,1\n")
    r = lexicon.from_ngrams(spark, str(tmp_path / "g.tsv")).first()
    assert (r.word, r.tag, r.capital_share, r.common) == ("gate", "NOUN", 0.5, True)


def test_index_sync(spark):
    want = spark.createDataFrame([(1, "a"), (2, "b")], "hash long, text string")
    saved = spark.createDataFrame([(2, 1), (3, 1)], "hash long, x int")
    add, drop = index.sync_plan(want, saved)
    assert [r.hash for r in add.collect()] == [1] and [r.hash for r in drop.collect()] == [3]
    sib = spark.createDataFrame([(1, "old", 1, [1.0, 2.0]), (1, "new", 2, [3.0, 4.0]), (1, "wide", 3, [1.0])], "hash long, collection string, mtime long, vector array<double>")
    assert index.adopt(add, sib, 2).first().vector == [3.0, 4.0]
    v = index.embed(want).collect()
    assert len(v[0].vector) == 64 and v[0].vector == index.embed(want).collect()[0].vector


def test_latch_function():
    class State:
        exists, value = False, None

        @property
        def get(self):
            return self.value

        def update(self, v):
            self.exists, self.value = True, v

    s, f = State(), latches.latch_function(2)
    run = lambda xs: next(f(("c", 1), iter([pd.DataFrame({"at": xs})]), s))["state"].tolist()
    assert run([5, 6, 8]) == ["fired", "held", "free"] and run([3]) == ["fired"] and run([5, 6]) == ["held", "free"]


def test_latch_stream(spark, tmp_path):
    rows = spark.createDataFrame([("c", 1, 4), ("c", 1, 2), ("d", 1, 3)], "chat_id string, entry_id long, at int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = latches.latch_stream(stream).writeStream.format("memory").queryName("latched").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    fired = {(r.chat_id, r.at) for r in spark.table("latched").filter("state = 'fired'").collect()}
    assert fired == {(r.chat_id, r.at) for r in latches.first_firings(rows).collect()} == {("c", 2), ("d", 3)}


def test_index_maintenance(spark, tmp_path):
    f = "entry_id long, world string, uid long, content string, disable boolean, saved_at timestamp"
    write = maintain.index_writer(str(tmp_path / "ix"))
    t = dt.datetime(2025, 1, 1)
    write(spark.createDataFrame([(1, "w", 1, "first text", False, t), (2, "w", 2, "second", False, t)], f), 0)
    write(spark.createDataFrame([(1, "w", 1, "changed text", False, t), (1, "w", 1, "old", False, dt.datetime(2024, 1, 1))], f), 1)
    write(spark.createDataFrame([(1, "w", 1, "changed text", False, t)], f), 1)  # a replay
    rows = maintain.current_index(spark, str(tmp_path / "ix")).collect()
    assert sorted(r.entry_id for r in rows) == [1, 2]
    want = index.wanted(spark.createDataFrame([(1, "w", 1, "changed text", False, t), (2, "w", 2, "second", False, t)], f))
    assert {r.hash for r in rows} == {r.hash for r in want.collect()}


def test_excerpts_and_spans(spark):
    texts = spark.createDataFrame([(1, "the gate — the Gate"), (2, None)], "row_id long, text string")
    rows = matching.excerpts(texts, "? =gate", 4).orderBy("at").collect()
    assert [r.excerpt for r in rows] == ["the «gate» — t", "the «Gate»"]
    s = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 10, 12), (2, 1, 2)], "row_id long, at int, until int")
    assert sorted((r.row_id, r.at, r.until, r.n) for r in matching.merge_spans(s, ["row_id"]).collect()) == [(1, 0, 8, 2), (1, 10, 12, 1), (2, 1, 2, 1)]

import pytest

from lorelake.functions import text as T
from lorelake.operators import activation, audit, matching, studies
from pyspark.sql import functions as F

ENTRY = "entry_id long, world string, uid long, key array<string>, content string"


def test_patterns():
    assert T.swap_hyphens("/a-b[c-d]x[-e][f-]\\-/i", "–") == "/a–b[c-d]x[–e][f–]\\-/i" and T.swap_hyphens("x-y", "–") is None
    assert ("/it’s/", "curly form") in T.other_spellings("/it's/") and T.other_spellings("/“a”/") == [('/"a"/', "straight form")]
    assert T.other_spellings("/a-b/") == [("/a–b/", "en dash")] and T.other_spellings("/ab/") == []


def test_words():
    assert T.stems("stopped") == ["stopp", "stoppe", "stop"] and T.stems("cities") == ["city"] and "boxe" in T.stems("boxes") and T.stems("glass") == []
    z = {"gate": 4.5, "the": 7.0, "orrery": 1.5, "of": 7.0}
    assert T.rarity("gate", z) == 0 and T.rarity("orrery", z) == 1 and T.rarity("brass orrery", z) == 1 and T.rarity("orrery of gate", z) == 1
    assert T.rarity("gates", z) == 0 and T.rarity("gate", z, frozenset({"gate"})) == 1
    assert len(T.whole_word_advice(["a b", "港", "? x y"])) == 2 and T.whole_word_advice(["gate"]) == []


def test_placed_segments():
    s = "one\n\ntwo\n---\nthree<p>four</p>"
    assert T.placed_segments(s, "scan") == [(0, s)]
    for window, n in (("message", 2), ("paragraph", 4)):
        got = T.placed_segments(s, window)
        assert len(got) == n and all(s[a : a + len(t)] == t for a, t in got)


def test_paths_and_promotion():
    assert audit.expression_paths("? (a OR =b) c") == ["? a c", "? =b c"] and audit.expression_paths("? /x/") == []
    assert activation.with_promotion("@@depth 3\ntext", True) == "@@promote\n@@depth 3\ntext"
    assert activation.with_promotion("@@promote\n@@depth 3\ntext", False) == "@@depth 3\ntext" and activation.with_promotion(None, True) == "@@promote\n"


def test_audit_probes(spark):
    e = spark.createDataFrame([(1, "w", 1, ["Mark", "/it's/"], "mark the marker; it’s 5mark"), (2, "w", 2, ["40"], "$40,000 and 40 and 1.40")], ENTRY)
    texts = e.select(F.col("entry_id").cast("string").alias("seg_id"), F.col("content").alias("text"))
    r = audit.substring_shares(matching.key_table(e), texts).filter("key = 'Mark'").first()
    assert (r["any"], r.as_word, r.in_case) == (1, 1, 0)
    c = audit.clean_hits(e, "40").first()
    assert (c.hits, c.clean) == (3, 1)
    assert [(r.entry_id, r.spelling) for r in audit.unreached_spellings(e).collect()] == [(1, "curly form")]


def test_studies(spark):
    rows = spark.createDataFrame([("s", "a", 1, True, 4, "x"), ("s", "a", 2, True, 0, "x"), ("s", "a", 3, False, 3, "y")], "scene string, arm string, entry_id long, delivered boolean, grade int, tier string")
    assert studies.delivered_f2(rows, ["scene"]).first().f2 == pytest.approx(0.5)
    assert {(r.tier, r.relevant, r.found) for r in studies.tier_recall(rows, ["tier"]).collect()} == {("x", 1, 1), ("y", 1, 0), (None, 2, 1)}
    fired = spark.createDataFrame([("s", 3), ("s", 1)], "scene string, entry_id long")
    assert {(r.entry_id, r.kind) for r in studies.divergences(rows, fired, ["scene", "entry_id"]).collect()} == {(2, "over-match"), (3, "miss")}
    runs = spark.createDataFrame([("s", "a", 1, 0), ("s", "b", 1, 2), ("s", "b", 2, 1), ("s", "b", 3, 9)], "scene string, arm string, entry_id long, rank int")
    got = studies.pool_extension(runs, rows.filter("entry_id = 2"), 5, ["scene", "entry_id"]).collect()
    assert [(r.entry_id, r.arms, r.best_rank) for r in got] == [(1, ["a", "b"], 0)]
    pairs = spark.createDataFrame([(1, 4, 4), (1, 3, 1), (1, 0, 1)], "k int, a int, b int")
    j = studies.judge_agreement(pairs, ["k"]).first()
    assert (j.exact, j.within_one, j.precision, j.recall) == pytest.approx((1 / 3, 2 / 3, 1.0, 0.5))
    assert studies.confusion(pairs, ["k"]).count() == 3
    f2 = spark.createDataFrame([("s1", "a", 0.1), ("s2", "a", 0.2), ("s1", "b", 0.5), ("s2", "b", 0.6)], "scene string, arm string, f2 double")
    r = studies.paired(f2, "scene", "arm", "a").first()
    assert (r.plus, r.minus) == (2, 0) and r["mean"] == pytest.approx(0.4)
    with pytest.raises(ValueError):
        studies.paired(f2.filter("NOT (scene = 's2' AND arm = 'b')"), "scene", "arm", "a")
    k = spark.createDataFrame([("a", 0), ("b", 2), ("b", 2), ("c", 500)], "key string, n long")
    assert {(r.band, r.rows, r["keys"]) for r in studies.rate_bands(k, F.col("n")).collect()} == {("0", 1, 1), ("1-3", 2, 1), (">100", 1, 1)}
    o = studies.token_offsets(spark.createDataFrame([("m", 10, 4), ("m", 12, 6)], "m string, r int, c int"), "r", "c", ["m"]).first()
    assert o.constant and o.low == 6
    kw = spark.createDataFrame([("s", 1, 5, 10)], "scene string, entry_id long, authored int, tokens int")
    sim = spark.createDataFrame([("s", 2, 1, 10, 0.9), ("s", 3, 2, 10, 0.1)], "scene string, entry_id long, authored int, tokens int, score double")
    assert [r.entry_id for r in studies.route_union(kw, sim, 1, 20).orderBy("upto").collect()] == [2, 1]


def test_sliding_blocks(spark):
    from lorelake.operators.scenes import sliding

    rows = spark.createDataFrame([(k, i, i * 7, f"{k}{i}") for k in "ab" for i in range(40)], "chat_id string, msg_id long, t long, mes string")
    for block in (4, 1000):
        got = {(r.chat_id, r.msg_id): r.said for r in sliding(rows, "chat_id", ["t", "msg_id"], 3, "mes", "said", block).collect()}
        assert got == {(k, i): [f"{k}{j}" for j in range(max(0, i - 2), i + 1)] for k in "ab" for i in range(40)}

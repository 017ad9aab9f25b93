import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorelake.functions import text as T
from lorelake.operators import activation, audit, delivery, dense, evaluation, filters, grades, keyedit, lexical, lineage, matching, relevance, suggest
from lorelake.plans import smartkeys as S

ENTRY = "entry_id long, world string, uid long, key array<string>, keysecondary array<string>, selective_logic int, comment string, content string, constant boolean, vectorized boolean, disable boolean, entry_group string"


@pytest.fixture(scope="module")
def entries(spark):
    def make(rows):
        base = {"keysecondary": [], "selective_logic": 0, "comment": None, "content": "", "constant": None, "vectorized": None, "disable": None, "entry_group": None, "key": []}
        cols = [c.split()[0] for c in ENTRY.split(", ")]
        full = [base | {"entry_id": i, "world": "w", "uid": i} | r for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[c] for c in cols) for r in full], ENTRY)

    return make


# --- delivery ---


def _walk(spark, n_constant, n_dynamic, tokens=10, **kw):
    rows = [("s", i, i, tokens, "constant" if i < n_constant else "dynamic", False, False, "b", 0) for i in range(n_constant + n_dynamic)]
    df = spark.createDataFrame(rows, "scene string, entry_id long, walk int, tokens int, block string, vector boolean, exempt boolean, book string, book_cap int")
    return delivery.budget(df, delivery.Caps(**kw)).orderBy("walk").collect()


def test_caps(spark):
    assert sum(r.admitted for r in _walk(spark, 7, 12, dynamic=10)) == 17
    assert sum(r.admitted for r in _walk(spark, 7, 12, total=10)) == 10
    out = _walk(spark, 7, 12)
    assert all(r.admitted for r in out)
    rows = [("s", i, i, 10, "dynamic", False, False, "b", 0) for i in range(19)]
    df = spark.createDataFrame(rows, "scene string, entry_id long, walk int, tokens int, block string, vector boolean, exempt boolean, book string, book_cap int")
    out = delivery.budget(df, delivery.Caps(tokens=45)).orderBy("walk").collect()
    assert sum(r.admitted for r in out) == 4 and out[-1].spent == 40 and out[-1].tail


def test_skip_goes_on_and_slack_once(spark):
    rows = [("s", 0, 0, 30, "dynamic", False, False, "b", 0), ("s", 1, 1, 30, "dynamic", False, False, "b", 0), ("s", 2, 2, 15, "dynamic", True, False, "b", 0), ("s", 3, 3, 8, "dynamic", True, True, "b", 1), ("s", 4, 4, 4, "dynamic", False, False, "b", 1)]
    df = spark.createDataFrame(rows, "scene string, entry_id long, walk int, tokens int, block string, vector boolean, exempt boolean, book string, book_cap int")
    out = delivery.budget(df, delivery.Caps(tokens=50)).orderBy("walk").collect()
    assert [r.admitted for r in out] == [True, False, True, True, False] and out[1].reasons == ["tokens"] and out[1].shortfall == 10 and out[4].reasons == ["book"] and out[3].in_prompt == 53
    out = delivery.budget(df, delivery.Caps(tokens=50, slack=0.3)).orderBy("walk").collect()
    assert [r.admitted for r in out] == [True, True, False, True, False]


def test_weighted_credit(spark):
    rows = spark.createDataFrame([(0.3, math.log(2)), (0.3, math.log(0.5)), (0.3, 0.0), (1.0, 1.0)], "e double, w double").select(relevance.weighted_credit(F.col("e"), F.col("w")).alias("x")).collect()
    odds = [r.x / (1 - r.x) for r in rows[:3]]
    assert odds == pytest.approx([6 / 7, 3 / 14, 3 / 7]) and rows[3].x == 1.0


def test_layout_blocks(spark):
    rows = [("s", 1, "dynamic", 0.2, 0.0, 5, 0, 1.0, 0), ("s", 2, "dynamic", None, 0.0, 1, 0, 1.0, 0), ("s", 3, "constant", 0.9, 0.0, 9, 0, 1.0, 0), ("s", 4, "dynamic", 0.9, 0.0, 3, 1, 0.1, 0), ("s", 5, "sticky", None, 0.0, 0, 0, 1.0, 0)]
    df = spark.createDataFrame(rows, "scene string, entry_id long, block string, e_credit double, log_weight double, authored long, tier int, weight double, offset int")
    order = lambda mode: [r.entry_id for r in delivery.layout(df, mode).orderBy("walk").collect()]
    assert order("interleaved") == [3, 5, 1, 4, 2] and order("sequential") == [3, 5, 1, 2, 4]


# --- lexical, dense ---


def test_bm25_against_loops(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["ash", "birch", "cedar", "dock", "elm"], k=rng.randint(0, 12)))) for i in range(40)]
    asked = {"ash", "elm", "none"}
    toks = {i: T.token_list(t) for i, t in docs}
    avg = sum(map(len, toks.values())) / 40
    want = {}
    for t in asked:
        df = sum(t in x for x in toks.values())
        for i, x in toks.items():
            if tf := x.count(t):
                want[i] = want.get(i, 0) + math.log(1 + (40 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / avg))
    got = {r.i: r.score for r in lexical.bm25(spark.createDataFrame([(t,) for t in asked], "term string"), spark.createDataFrame(docs, "i long, text string"), "i").collect()}
    assert got == pytest.approx(want)


def test_three_equal_paragraphs_score_as_one(spark, entries):
    p = "the lantern of the harbor was lit again by the old keeper before dawn, " * 3
    df = entries([{"content": f"{p}\n\n{p}\n\n{p}"}, {"content": p}, {"content": "something else entirely, " * 10}])
    got = {r.entry_id: r.score for r in lexical.bm25_entries(spark.createDataFrame([("lantern",)], "term string"), df).collect()}
    assert got[0] == pytest.approx(got[1])


def test_search_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)) + 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0, 2.0]), (901, None), (902, [0.0] * 8)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for centre in (False, True):
        fit = dense.one_dimension(base, 8)
        y = np.vstack([x.astype(np.float32), np.zeros((1, 8))]) - (np.vstack([x, np.zeros((1, 8))]).mean(0) if centre else 0)
        n = np.linalg.norm(y, axis=1, keepdims=True)
        sim = np.where(n > 0, y / np.where(n > 0, n, 1), 0)
        got = dense.search(base.filter("vec_id IN (0, 7, 33)"), fit, 5, centre, block=2).orderBy("query_id", "rank").collect()
        for q in (0, 7, 33):
            s = sim @ sim[q]
            s[q] = -9
            assert [r.score for r in got if r.query_id == q] == pytest.approx(sorted(s, reverse=True)[:5], abs=1e-5)


def test_components_remove_spread(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4)) * [9, 3, 1, 0.1]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    mean, comps, scales = dense.components(base, 2)
    assert abs(comps[0][0]) > 0.99 and scales[0] == pytest.approx(np.linalg.svd(x - x.mean(0))[1][0] / math.sqrt(80), rel=1e-6)
    left = np.array([r.v for r in base.select(dense.project_out(F.col("embedding"), mean, comps).alias("v")).collect()])
    assert np.allclose(left @ comps.T, 0, atol=1e-9)
    assert np.allclose(left, (x - x.mean(0)) - (x - x.mean(0)) @ comps.T @ comps)


# --- evaluation ---


def test_logistic_fit(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 600))
    y = rng.random(600) < 1 / (1 + np.exp(-(0.5 + 1.2 * a - 0.7 * b)))
    df = spark.createDataFrame([(float(p), float(q), int(z)) for p, q, z in zip(a, b, y)], "a double, b double, label int")
    fit = evaluation.logistic_fit(df, ["a", "b"])
    x = np.stack([np.ones(600), a, b], 1)
    mu = 1 / (1 + np.exp(-x @ fit["beta"]))
    assert fit["converged"] and np.abs(x.T @ (y - mu)).max() < 1e-4 and fit["beta"] == pytest.approx([0.5, 1.2, -0.7], abs=0.35)
    assert evaluation.cumulative_fit(df.withColumn("g", F.col("label") * 2), ["a"], "g", [1, 3])[3] is None


def test_sign_test_and_null(spark):
    df = spark.createDataFrame([(1, 1.0)] * 9 + [(1, -1.0)] + [(1, 0.0)], "k int, delta double")
    r = evaluation.sign_test(df, ["k"]).first()
    assert (r.plus, r.minus, r.ties) == (9, 1, 1) and r.p == pytest.approx(2 * 11 / 1024)
    mean, share = evaluation.calibration_null([(100, 0.2, 0.2), (100, 0.8, 0.3)], 200)
    assert 0 < mean < 0.1 and share == 0


def test_lower_median_and_human(spark):
    rows = [(1, i, "llm", g, True) for i, g in enumerate([4, 0, 3, 1])] + [(2, 0, "human", 1, True), (2, 1, "llm", 4, True), (2, 2, "human", 2, True), (3, 0, "llm", 4, True), (3, 1, "llm", 0, True), (4, 0, "llm", 9, False)]
    got = {r.item_id: (r.grade, r.rule) for r in grades.in_force(spark.createDataFrame(rows, "item_id long, pos int, kind string, grade int, valid boolean"), ["item_id"]).collect()}
    assert got == {1: (1, "median"), 2: (2, "human"), 3: (0, "latest")}


def test_merge_passes(spark):
    f = "item long, rater_id string, graded_at string, grade int"
    prior = spark.createDataFrame([(1, "a", "2025-01-01T01", 3)], f)
    fresh = spark.createDataFrame([(1, "a", "2025-01-01T09", 1), (1, "a", "2025-01-02T09", 2), (1, "b", "2025-01-01T09", 4)], f)
    out = {(r.rater_id, r.graded_at): r.grade for r in grades.merge_passes(prior, fresh, ["item"], F.substring("graded_at", 1, 10)).collect()}
    assert out == {("a", "2025-01-01T01"): 3, ("a", "2025-01-02T09"): 2, ("b", "2025-01-01T09"): 4}


# --- matching and activation ---


def test_match_units_against_loops(spark, entries):
    keys = [["gate"], ["ray-ban", "? lantern::2 OR bridge"], ["/br[io]dge/"], ["? -x"], ["? -harbor gate"], ["? (gate road)~1"], None, [" "]]
    sec = [["road"], [], [], [], [], [], [], []]
    df = entries([{"key": k, "keysecondary": s, "disable": False} for k, s in zip(keys, sec)])
    texts = ["the gate and the road", "ray ban lantern bridge", "gate", "nothing", "bridge gate harbor", "GATE, road"]
    segs = spark.createDataFrame([(str(i), "w" if i != 3 else "other", t) for i, t in enumerate(texts)], "seg_id string, world string, text string")
    got = {(r.entry_id, r.key, r.seg_id) for r in matching.match_units(df, segs).collect()}
    want = set()
    for e, (ks, s) in enumerate(zip(keys, sec)):
        for k in S.usable_keys(ks):
            for i, t in enumerate(texts):
                if i != 3 and S.evaluate(S.gated(k.strip(), s, 0), S.Segment(t)).matched:
                    want.add((e, k.strip(), str(i)))
    assert got == want


def test_keyword_score(spark, entries):
    df = entries([{"key": ["sunglass", "? ray-ban::3"]}])
    segs = spark.createDataFrame([("0", "w", "sunglass sunglass ray-ban"), ("1", "w", "sunglass")], "seg_id string, world string, text string")
    scene = spark.createDataFrame([("0", "c"), ("1", "c")], "seg_id string, chat_id string")
    r = matching.keyword_scores(matching.match_units(df, segs), scene).first()
    assert r.hits == 2 and r.score == pytest.approx(1 + math.log(1 + 2 / 1.2) + 3) and r.log_weight == pytest.approx(math.log(3))


def test_joint_recursion(spark, entries):
    df = entries([{"key": ["start"], "content": "amber"}, {"key": ["amber"], "content": "birch"}, {"key": ["? amber & birch"], "content": "cedar"}, {"key": ["? birch & gate"], "content": "x"}, {"key": ["? (amber birch)~2"], "content": "y"}, {"key": ["? cedar -gate"], "content": "z"}])
    seeds = spark.createDataFrame([("c", 0), ("d", 0)], "chat_id string, entry_id long")
    scenes = spark.createDataFrame([("c", "w", "start at the gate"), ("d", "w", "start")], "chat_id string, world string, text string")
    rows = lambda **k: {(r.chat_id, r.entry_id): r.depth for r in activation.recursion(df, seeds, **k).collect()}
    both = {("c", 0): 0, ("d", 0): 0, ("c", 1): 1, ("d", 1): 1}
    assert rows(window="message") == both
    assert rows(window="scan", scenes=scenes) == both | {("c", 2): 2, ("d", 2): 2, ("c", 3): 2, ("d", 5): 3}
    late = df.withColumn("delay_until_recursion", F.when(F.col("entry_id") == 2, 4).otherwise(0))
    assert {(r.chat_id, r.entry_id): r.depth for r in activation.recursion(late, seeds, window="scan", scenes=scenes).collect()}["c", 2] == 4


def test_recursion_keeps_paragraphs_apart(spark, entries):
    df = entries([{"key": ["start"], "content": "amber\n\nbirch"}, {"key": ["? amber & birch"], "content": "x"}])
    seeds = spark.createDataFrame([("c", 0)], "chat_id string, entry_id long")
    n = lambda w: activation.recursion(df, seeds, window=w).count()
    assert (n("paragraph"), n("message"), n("scan")) == (1, 2, 2)


def test_decomposed_accents(spark):
    rows = spark.createDataFrame([(1, "Cafe\u0301 cafe\u0301 Vie\u0323\u0302t q\u0307a"), (2, "Café café Việt q\u0307a")], "doc_id long, text string")
    folded = [r.f for r in rows.select(T.fold("text").alias("f")).collect()]
    assert folded[0] == folded[1] == T.fold_text("Café café Việt q\u0307a")
    post = {(r.doc_id, r.term): (r.tf, r.dl) for r in lexical.postings(rows, ["doc_id"]).collect()}
    assert post[1, "café"] == post[2, "café"] == (2, 4) and {t for d, t in post if d == 1} == {t for d, t in post if d == 2}


def test_recursion(spark, entries):
    df = entries([{"key": ["start"], "content": "speaks of alpha"}, {"key": ["alpha"], "content": "speaks of beta and alpha"}, {"key": ["beta"], "content": "gamma"}, {"key": ["gamma"], "content": "start"}, {"key": ["delta"], "content": "x"}])
    seeds = spark.createDataFrame([("c", 0)], "chat_id string, entry_id long")
    depths = lambda d, n=0: {r.entry_id: r.depth for r in activation.recursion(d, seeds, n).collect()}
    assert depths(df) == {0: 0, 1: 1, 2: 2, 3: 3} and depths(df, 1) == {0: 0, 1: 1}
    assert depths(df.withColumn("prevent_recursion", F.col("entry_id") == 1)) == {0: 0, 1: 1}
    assert depths(df.withColumn("exclude_recursion", F.col("entry_id") == 1)) == {0: 0}
    assert depths(df.withColumn("delay_until_recursion", F.when(F.col("entry_id") == 1, 2).otherwise(0))) == {0: 0, 1: 2, 2: 3, 3: 4}


def test_decorators(spark, entries):
    assert activation.decorator_lines("@@depth 3\n@@unknown\n@@@role user\n@@@position before_desc\ntext\n@@depth 9") == [("@@depth", "3"), ("@@role", "user")]
    assert activation.field_patch("@@depth 3\n@@role user\n@@additional_keys a, b\n@@exclude_keys c") == {"position": 4, "depth": 3, "role": 1, "keysecondary": ["a", "b"], "selective": True, "selective_logic": 0, "exclude_keys": ["c"]}
    assert activation.field_patch("@@role system") == {"role": 0, "position": 4, "depth": 4} and activation.field_patch("@@position scenario\n@@role user") == {"position": 1}
    assert activation.field_patch("@@reverse_depth 2", chat_length=10) == {"position": 4, "depth": 8} and activation.field_patch("plain") == {}
    df = entries([{"content": c} for c in ("@@activate_only_after 3", "@@activate_only_every 2", "@@dont_activate_after_match 2", "@@keep_activate_after_match", "@@is_greeting 1", "@@is_user_icon Ann", "plain")])
    j = df.join(activation.decorators(df), "entry_id", "left").withColumn("delay", F.lit(None).cast("int"))

    def verdicts(length, count, greeting, persona, fired):
        v = activation.gate_verdict(*[F.lit(x).cast(t) for x, t in ((length, "int"), (count, "int"), (greeting, "int"), (persona, "string"), (fired, "int"))])
        return [r.v for r in j.select("entry_id", v.alias("v")).orderBy("entry_id").collect()]

    assert verdicts(5, 2, 0, "Bob", None) == ["skip", None, None, None, "skip", "skip", None]
    assert verdicts(5, 3, 1, "Ann", 4) == [None, "skip", "skip", "admit", None, None, None]
    assert verdicts(9, 4, None, None, 4) == [None, None, None, "admit", None, None, None]
    assert verdicts(3, None, None, None, 4) == [None] * 7  # a firing that lies ahead is undone
    assert {r.gate for r in activation.unmodelled_gates(df, {"assistant_count", "fired"}).collect()} == {"@@is_greeting", "@@is_user_icon"}


# --- audit, suggestion, catalogue ---


def test_near_duplicates_brute_force(spark, entries):
    rng = random.Random(9)
    pool = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(120)]
    base = [rng.sample(pool, 40) for _ in range(6)]
    rows = []
    for i in range(60):
        words = list(base[i % 6])
        for _ in range(rng.choice([0, 0, 2, 4, 12])):
            words[rng.randrange(40)] = rng.choice(pool)
        rows.append({"content": " ".join(words), "comment": "[Arc] x" if i % 11 == 0 else None})
    df = entries(rows)
    vocab = [set(r["content"].split()) for r in rows]
    link = lambda i, j: len(vocab[i] & vocab[j]) / len(vocab[i] | vocab[j]) >= 0.8 and (rows[i]["comment"] == rows[j]["comment"])
    arc = [bool(r["comment"]) for r in rows]
    group = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if i != j and link(i, j):
                    group[i] = group[j] = min(group[i], group[j])
    got = {r.entry_id: r for r in audit.near_duplicates(df, 0.8).collect()}
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(group))
    for i in range(60):
        distinct = {frozenset(vocab[j]) for j in range(60) if j != i and link(i, j) and vocab[j] != vocab[i] and arc[j] == arc[i]}
        assert got[i].links == len(distinct)


def test_flags(spark, entries):
    rows = [{"key": ["? -x", "lonely", "Odd Name", "of the", "is"], "content": "is this of the gate"}] + [{"key": ["gate"], "content": "the gate"} for _ in range(9)]
    got = {(r.entry_id, r.key): r.flag for r in audit.flags(entries(rows), function_words=["of", "the"]).collect()}
    assert got[0, "? -x"] == "unusable" and got[0, "lonely"] == "unattested" and (0, "Odd Name") not in got and got[0, "of the"] == "fragment" and got[0, "is"] == "short" and got[1, "gate"] == "book common"


def test_counts_of_expressions_and_patterns(spark, entries):
    keys = ["? lantern OR /br[iy]dge/", "? -harbor", "/gate\\d/", "? (lantern gate1)~3", "? lantern::2", "oak", "? ("]
    df = entries([{"key": keys, "content": "lantern lantern"}, {"content": "brydge gate7"}, {"content": "harbor"}, {"world": "v", "key": ["/oak/"], "content": "oak"}])
    chat = spark.createDataFrame([(1, "a brydge"), (2, "the lantern by gate1"), (3, "harbor gate2 gate3")], "msg_id long, mes string")
    texts = [r.mes for r in chat.collect()]
    got = {r.key: (r.messages_with, r.messages) for r in audit.chat_counts(df, chat).collect()}
    usable = [k for k in [*keys, "/oak/"] if not S.fatal(k)]
    assert got == {k: (sum(S.count_key(k, t) > 0 for t in texts), 3) for k in usable}
    assert got[keys[0]] == (2, 3) and got[keys[2]] == (2, 3) and got[keys[3]] == (1, 3)
    book = {(r.world, r.key): (r.df, r.total) for r in audit.book_counts(df).collect()}
    assert book["w", keys[0]][0] == 2 and book["w", keys[2]] == (1, 1) and book["w", keys[4]] == (1, 4) and book["v", "/oak/"] == (1, 1) and book["w", "oak"] == (0, 0)
    flags = {r.key: (r.flag, r.severity) for r in audit.flags(df, chat).collect()}
    assert flags[keys[0]] == ("chat common", "severe") and flags[keys[2]] == ("chat common", "severe")
    ten = entries([{"key": ["/xyzzy/", "/gate/"], "content": "gate"}] + [{"content": "gate"}] * 9)
    assert {r.key: r.flag for r in audit.flags(ten).collect()} == {"/xyzzy/": "unattested", "/gate/": "book common"}


def test_suggestions(spark, entries):
    filler = [{"content": f"The clerk walks by the quiet river {i} and counts old coins."} for i in range(12)]
    df = entries([{"content": "We met Tarn Oldway at noon. Then Tarn Oldway sang. Later Tarn Oldway left.", "key": ["noon"]}, *filler])
    pack = suggest.LanguagePack(function_words=frozenset("the we at then by and".split()))
    got = [r.gram for r in suggest.suggestions(df, pack).filter("entry_id = 0").orderBy("rank").collect()]
    assert got[0] == "tarn oldway" and "noon" not in got
    assert suggest.parse_key_list("1. “Tarn Oldway”\n- brass orrery, coins.\nthis line has far too many words in it") == ["Tarn Oldway", "brass orrery", "coins"] or suggest.parse_key_list("- coins.\n2) gate") == ["coins", "gate"]


def test_lineages_and_names(spark, entries):
    rows = [{"world": "a long name", "content": "x"}, {"world": "a long name", "content": "y"}, {"world": "b", "content": " X "}, {"world": "b", "content": "z"}, {"world": "c", "content": "q"}]
    assert {r.world: r.lineage for r in lineage.lineages(entries(rows)).collect()} == {"a long name": "b", "b": "b", "c": "c"}
    n = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    got = {r.name: r.nearest for r in lineage.nearest_name(n(["Old_Book 2", "Tomee", "zzzzzzzz"]), n(["old book", "old-book 2 extra", "tome"])).collect()}
    assert got == {"Old_Book 2": "old-book 2 extra", "Tomee": "tome", "zzzzzzzz": None}


def test_key_edits(spark, entries):
    df = entries([{"key": ["Night", "day", None]}, {"key": ["night", "Midnight "]}, {"key": None}])
    assert [r.key for r in keyedit.rename_key(df, "NIGHT", "midnight").orderBy("entry_id").collect()] == [["midnight", "day", None], ["Midnight "], None]
    assert [r.edited for r in keyedit.delete_key(df, "day").orderBy("entry_id").collect()] == [True, False, False]
    assert [r.keysecondary for r in keyedit.add_secondary(df, "x").collect()] == [["x"]] * 3
    moves, conflicts = keyedit.reindex_plan(entries([{}] * 4), spark.createDataFrame([("w", 0, 0), ("w", 1, 1)], "world string, uid long, place int"), 1)
    assert sorted((r.uid, r.target) for r in moves.collect()) == [(0, 1), (1, 2)] and [r.uid for r in conflicts.collect()] == [2]
    rec = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "key string, at int")
    kept, lost = keyedit.rekeyed(rec, spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "d")], "key string, target string"))
    assert {r.key: r.at for r in kept.collect()} == {"b": 1, "a": 2, "d": 3} and {r.key: r.at for r in lost.collect()} == {"d": 4}


def test_search_and_facets(spark, entries):
    df = entries([{"comment": "Lantern", "content": "harbor"}, {"key": ["a lantern"], "vectorized": True}, {"content": "the lantern"}, {"content": "lantern harbor", "disable": True}])
    assert {r.entry_id: r.found_in for r in filters.search(df, "lantern -harbor").collect()} == {0: 0, 1: 1, 2: 2}
    assert [r.entry_id for r in filters.faceted(df, {"vector", "enabled"}).collect()] == [1]

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorelake.functions import text as T
from lorelake.plans import smartkeys as S

BOTH = "The sunglass and the ray-ban lay there."


def score(key, text):
    r = S.evaluate(S.build(key), S.Segment(text))
    return sum(w / n * (1 + math.log(1 + (n - 1) / 1.2)) for _, w, n in r.units) if r.matched else 0


@pytest.mark.parametrize("key,want", [("? sunglass OR ray-ban", 1.6061), ("? sunglass OR ray-ban::5", 4.8184), ("? (sunglass OR ray-ban)::5", 8.0307), ("? sunglass XOR ray-ban", 0), ("? sunglass AND ray-ban", 2), ("? sunglass::0 AND ray-ban", 1)])
def test_weights(key, want):
    assert score(key, BOTH) == pytest.approx(want, abs=5e-5)


@pytest.mark.parametrize("key,text,want", [
    ("? Neil Armstrong?", "Neil left", 1), ("? Neil Armstrong?", "Armstrong left", 0), ("? Neil Armstrong?", "Neil Armstrong", 2),
    ("? (mission mars)~2", "the mission mars", 1), ("? (mission mars)~2", "mission to mars", 1), ("? (mission mars)~2", "mission a b c d e f mars", 0),
    ("? (a1 b1 -c1)~2", "a1 b1 x x x x c1", 1), ("? (a1 b1 -c1)~2", "a1 b1 c1", 0), ("? (a1 OR b1)~0", "a1 b1", 2), ("? ((a1 b1)~0 c1)~3", "a1 b1 x c1", 1),
    ("aa", "aaa", 1), ("ray-ban", "ray ban, ray-ban", 2), ("/\\bcat\\b/i", "Cat cats CAT", 2), ("/[/", "x", 0), ("? \"the gate\"", "The Gate", 1), ("? ^Gate", "gate Gate", 1),
    ("? -harbor gate", "gate", 1), ("? gate -harbor", "gate harbor", 0), ("? a1 || b1", "b1", 1), ("? +gate", "gate", 1), ("gate", "<b gate>x</b>", 0), ("? sci-fi", "sci-fi", 1), ("café", "café", 1),
])
def test_counts(key, text, want):
    assert S.count_key(key, text) == want


def test_whole_words():
    count = lambda k, t, m="strict": S.count_key(k, t, whole=True, mode=m)
    assert count("caf", "café") == 0 and count("gate", "gate-keeper, gate") == 1 and count("gate", "gate-keeper", "permissive") == 1 and count("gate", "gate—keeper") == 1 and count("a b", "a b a b") == 2


def test_gates():
    ok = lambda logic, text, sec=("b1", "c1"): S.evaluate(S.gated("a1", list(sec), logic), S.Segment(text)).matched
    assert [[ok(logic, t) for t in ("a1", "a1 b1", "a1 b1 c1", "b1 c1")] for logic in range(4)] == [[False, True, True, False], [True, True, False, False], [True, False, False, False], [False, False, True, False]]
    assert ok(0, "a1", ("", None)) and not ok(0, "a1", ("? )",))
    assert not S.evaluate(S.gated("a1", [], 0, excluded=["x1"]), S.Segment("a1 x1")).matched


@pytest.mark.parametrize("key,codes", [
    ("?", ["no-terms"]), ("? -a", ["negation-only"]), ("? a?", ["no-required-term"]), ("? a OR b?", ["always-true"]), ("? ?", ["punctuation-term"]), ("? a ::3", ["stray-weight"]), ('? "x y"~3', ["proximity-on-phrase"]),
    ("? =/re/", ["flag-on-pattern"]), ("/(/", ["regex-invalid"]), ("? (a", ["unbalanced-parens"]), ("? a::0", ["all-zero-weights"]), ('? "moon', ["stray-quote"]), ("? (a b)~2 ~3", ["stray-proximity"]), ("plain", []), ("/a/b/", ["regex-core-refuses"]),
    ("? " + "(" * 120 + "a" + ")" * 120, ["too-deep"]),
])
def test_alerts(key, codes):
    assert list(S.validate(key)) == codes


POOL = ["ash", "birch", "cedar", "dock", "elm", "fir"]
TOKENS = POOL + ["AND", "OR", "NOT", "XOR", "(", ")", ")~2", ")::2", ")?", "-ash", "=elm", "^fir", "cedar::0", "dock?", '"ash birch"', "|", "&", "/el?m/"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(TOKENS), max_size=9))
def test_any_key_is_safe(tokens):
    key = "? " + " ".join(tokens)
    texts = [" ".join(w for i, w in enumerate(POOL) if n >> i & 1) for n in range(64)]
    counts = [S.count_key(key, t or " ") for t in texts]
    assert all(c >= 0 and math.isfinite(c) for c in counts)
    if not any(S.ALERTS[a] == "error" for a in S.validate(key)):
        assert not counts[0]


def test_compiled_columns_agree(spark):
    texts = ["gate and lantern", "Gate-keeper", "the GATE", "lantern harbor", "", "gat e", "x—gate—y", "<i gate>z</i>", "ray ban"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    hay = T.masked("t")
    for key in ["? gate", "? =gate OR harbor", "? gate -lantern", "? gate XOR lantern", "? ^GATE", "? gate lantern?", "? /g.t\\b/", "? ray-ban"]:
        got = {r.i for r in df.filter(S.compile_match(S.build(key), T.fold(hay), T.ortho(hay), F.col("t"))).collect()}
        assert got == {i for i, t in enumerate(texts) if S.count_key(key, t)}, key


def test_a_slow_pattern_still_counts(monkeypatch):
    class Slow:
        def finditer(self, text, timeout=None):
            if timeout is not None:
                raise TimeoutError
            return re.finditer("gate", text)

    monkeypatch.setattr(S, "compiled", lambda key: Slow())
    assert S.count_key("/gate/", "gate by gate") == 2

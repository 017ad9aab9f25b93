import random
import time

import numpy as np
import pytest

from lorelake.llm import consensus

ITEM = "item_id long, capture_id string, grades array<struct<rater:int,grade:int,graded_at:string,why:string>>, grade int, p string"
RATER = "capture_id string, rater int, kind string, rater_id string, grade int"


def _at(i):
    return f"2025-01-01T00:{i:02d}:00.000Z"


def test_held_out_accuracy_beats_majority(spark):
    rng = random.Random(5)
    care = [0.95, 0.92, 0.9, 0.2, 0.2, 0.2]  # and one that always says 2
    truth, items, votes = {}, [], {}
    for i in range(400):
        truth[i] = rng.choices(range(5), [4, 2, 2, 1, 1])[0]
        gs = [(r, truth[i] if rng.random() < c else rng.randrange(5), _at(r), None) for r, c in enumerate(care)] + [(6, 2, _at(6), None)]
        votes[i] = [g[1] for g in gs]
        items.append((i, "c", gs, 9, "x"))
    raters = [("c", r, "llm", f"r{r}", 1) for r in range(7)]
    rows = consensus.consensus(spark.createDataFrame(items, ITEM), spark.createDataFrame(raters, RATER)).collect()
    right = sum(r.grade == truth[r.item_id] for r in rows) / 400
    majority = sum(max(range(5), key=lambda k: (v.count(k), -k)) == truth[i] for i, v in votes.items()) / 400
    assert right > 0.93 and right > majority
    rel = {r.rater_id: r.reliability for r in consensus.reliability(spark.createDataFrame(items, ITEM), spark.createDataFrame(raters, RATER)).collect()}
    assert min(rel[f"r{r}"] for r in range(3)) > max(rel[f"r{r}"] for r in range(3, 7))


def _dense(edges, rounds_of=200):
    """The same messages on a table of all raters and items."""
    raters, items, k = sorted({r for _, r, _ in edges}), sorted({i for i, _, _ in edges}), 5
    grade = {(i, r): g for i, r, g in edges}
    share = np.array([(sum(g == c for *_, g in edges) + 1) / (len(edges) + k) for c in range(k)])
    prior = 0.25 * share[:, None].repeat(k, 1) + 0.25 * np.eye(k)
    p = {e: np.mean([np.eye(k)[g] for (j, _), g in grade.items() if j == e[0]], 0) for e in grade}
    for _ in range(rounds_of):
        inside = {(r, g): sum((p[e] for e in grade if e[1] == r and grade[e] == g), np.zeros(k)) for r in raters for g in range(k)}
        lend = {e: np.log((inside[e[1], g] - p[e] + prior[g]) / (sum(inside[e[1], c] for c in range(k)) - p[e] + 0.5)) for e, g in grade.items()}
        soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        every = {i: np.log(share) + sum(lend[e] for e in grade if e[0] == i) for i in items}
        whole = {i: soft(x) for i, x in every.items()}
        after = {e: soft(every[e[0]] - lend[e]) for e in grade}
        moved = np.mean([np.abs(after[e] - p[e]).mean() for e in grade])
        p = after
        if moved < consensus.TOLERANCE:
            break
        share = np.mean(list(whole.values()), 0)
    return whole


def _edges(seed, n=60):
    rng = random.Random(seed)
    truth = {i: rng.choices(range(5), [4, 2, 2, 1, 1])[0] for i in range(n)}
    return [(i, f"r{r}", truth[i] if rng.random() < c else rng.randrange(5)) for i in range(n) for r, c in enumerate([0.9, 0.8, 0.7, 0.3, 0.95, 0.5]) if rng.random() < 0.8]


@pytest.mark.parametrize("most", [consensus.RATERS, 0])
def test_against_brute_force(spark, most):
    edges = _edges(3)
    want = _dense(edges)
    got = consensus.pass_messages(spark.createDataFrame(edges, "item_id long, rater_id string, grade int"), most=most)
    rows = {r.item_id: r.p for r in got.items.collect()}
    assert got.settled and rows.keys() == want.keys() and all(np.allclose(rows[i], want[i], atol=1e-9) for i in want)


@pytest.mark.parametrize("most,rounds", [(consensus.RATERS, 60), (0, 25)])
def test_late_rounds_take_no_longer(spark, monkeypatch, most, rounds):
    at, real = [], consensus.stored
    monkeypatch.setattr(consensus, "stored", lambda *a, **k: (at.append(time.time()), real(*a, **k))[1])
    with pytest.warns(UserWarning, match="still move"):
        out = consensus.pass_messages(spark.createDataFrame(_edges(4, 20), "item_id long, rater_id string, grade int"), tolerance=-1.0, max_rounds=rounds, most=most)
    assert not out.settled and out.rounds == rounds and out.items.count() == 20
    took = np.diff(at)
    assert np.median(took[-10:]) < 2 * np.median(took[3:13]) + 0.2


def test_odd_verdicts(spark):
    gs = [(0, 7, _at(1), None), (0, None, _at(2), None), (1, 3, _at(3), None), (1, 1, _at(1), None), (2, 3, None, None), (9, 4, _at(1), None), None, (None, 2, _at(1), None)]
    items = [(1, "c", gs, 0, "x"), (2, "c", [], 0, "x"), (3, "c", None, 0, "x"), (4, None, gs, 0, "x"), (5, "c", [(1, 0, _at(1), None)] * 3, 0, "x"), (1, "c", gs, 0, "x")]
    raters = [("c", 0, None, "a", 1), ("c", 1, "HUMAN", "b", 1), ("c", 2, "llm", "b2", 1), ("c", 3, "llm", None, 1), ("c", 4, "llm", "b", 1)]
    rows = {r.item_id: r for r in consensus.consensus(spark.createDataFrame(items, ITEM), spark.createDataFrame(raters, RATER)).collect()}
    assert set(rows) == {1, 5} and rows[1].grade == 3 and rows[1].n_raters == 2 and rows[5].grade == 0 and rows[5].agreement is None


def test_empty(spark):
    i, r = spark.createDataFrame([], ITEM), spark.createDataFrame([], RATER)
    assert consensus.consensus(i, r).count() == 0 and consensus.reliability(i, r).count() == 0

import random

import pytest

from lorelake.llm import leakage as L

DOC = "doc_id long, text string, term string, block string"
ITEM = "item_id long, text string, term string"


def _words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def _brute(item, doc, words, edits):
    """Whether some run of ``words`` item words aligns with a run of the document within ``edits``, from equal word to equal word."""
    for a in range(len(item) - words + 1):
        part = item[a : a + words]
        rows = {0: [0] * (len(doc) + 1)}
        prev = [0 if j < len(doc) and doc[j] == part[0] else 99 for j in range(len(doc))]
        # edit distance of part against doc[j:...], starting on an equal first word
        for j in (j for j, x in enumerate(prev) if x == 0):
            d = list(range(len(doc) - j))
            d = [x for x in range(len(doc) - j)]
            for i in range(1, words):
                nd = [d[0] + 1]
                for k in range(1, len(d)):
                    nd.append(min(d[k] + 1, nd[k - 1] + 1, d[k - 1] + (doc[j + k] != part[i])))
                d = nd
            ends = [x for k, x in enumerate(d) if doc[j + k] == part[-1]]
            if ends and min(ends) <= edits:
                return True
        rows.clear()
    return False


def _edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(2, len(out) - 2)
        kind = rng.randrange(3)
        out[i : i + (kind != 0)] = [] if kind == 1 else ["edit%d" % rng.randrange(9)]
    return out


def test_against_alignment(spark):
    rng = random.Random(4)
    items = {i: _words(rng, 60) for i in range(12)}
    docs, planted = [], set()
    for d in range(120):
        base = _words(rng, rng.randint(0, 60))
        i, n = rng.randrange(12), rng.choice([10, 16, 18, 20, 24, 30, 40])
        a = rng.randrange(60 - n + 1)
        base[len(base) // 2 : len(base) // 2] = _edited(rng, items[i][a : a + n], rng.choice([0, 0, 1, 2, 3, 4]) if n > 12 else 0)
        docs.append((d, " ".join(base)))
    rows = [(d, t.upper() if d % 3 == 0 else t.replace(" ", ",\n> ", 5), "clash", "clash") for d, t in docs]
    found = {(r.doc_id, r.item_id) for r in L.leaks(spark.createDataFrame(rows, DOC), spark.createDataFrame([(i, " ".join(w), "clash") for i, w in items.items()], ITEM)).collect()}
    for d, t in docs:
        for i, w in items.items():
            if any(_brute(w, t.split(), n, k) for n, k in L.PASSAGES):
                planted.add((d, i))
    assert planted and found == planted


def test_instruction_and_edges(spark):
    rng = random.Random(6)
    w = _words(rng, 30)
    task = "Judge how well the entry fits the scene that is described in the lines that follow this one here today."
    items = [(i, f"{task}\n\n{' '.join(_words(rng, 30))}", "x") for i in range(4)] + [(9, " ".join(w), "x"), (10, None, "x"), (11, "", "x"), (12, "too short", "x")]
    docs = [(1, task, "x", "x"), (2, " ".join(w), "x", "x"), (2, " ".join(w), "x", "x"), (3, None, "x", "x"), (4, " \n", "x", "x"), (5, " ".join(reversed(w)), "x", "x"), (6, "fill " * 30_000 + " ".join(w), "x", "x")]
    rows = sorted((r.doc_id, r.item_id) for r in L.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect())
    assert rows == [(2, 9), (2, 9), (6, 9)]


@pytest.mark.parametrize("docs,items", [(0, 1), (1, 0), (0, 0)])
def test_empty(spark, docs, items):
    d = spark.createDataFrame([(1, "a b", "x", "x")][:docs], DOC)
    i = spark.createDataFrame([(1, "a b", "x")][:items], ITEM)
    assert L.leaks(d, i).count() == 0


def test_item_buckets(spark, monkeypatch):
    monkeypatch.setattr(L, "BUCKET_WORDS", 50)
    rng = random.Random(8)
    items = [(i, " ".join(_words(rng, 25)), "x") for i in range(5)]
    docs = [(i, t, "x", "x") for i, t, _ in items]
    assert sorted((r.doc_id, r.item_id) for r in L.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()) == [(i, i) for i in range(5)]

"""Registered queries on small tables of their own: each does the whole job."""

import datetime as dt

import numpy as np
import pytest

from lorelake.plans.queries import QUERIES

ENTRY = "entry_id long, world string, uid long, key array<string>, keysecondary array<string>, selective_logic int, comment string, content string, constant boolean, vectorized boolean, disable boolean, saved_at timestamp"
MESSAGE = "msg_id long, chat_id string, name string, is_user boolean, is_system boolean, send_date string, mes string"


@pytest.fixture
def tables(spark, tmp_path):
    def write(**frames):
        for name, (rows, schema) in frames.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def _book(rows):
    return [(i, "w", i, k, [], 0, None, c, None, None, None, dt.datetime(2025, 1, 1)) for i, (k, c) in enumerate(rows)], ENTRY


def test_recursion_starts_in_chats_and_goes_on(spark, tables):
    names = ["amber", "birch", "cedar", "dahlia", "elder", "fennel", "garlic"]
    book = [(["unsaid"], "amber")] + [([a], b) for a, b in zip(names, [*names[1:], "the end"])]
    d = tables(book_entries=_book(book), chats=([("c", "w"), ("e", None)], "chat_id string, world_info string"), chat_messages=([(1, "c", "A", True, False, "1709251200000", "some amber")], MESSAGE))
    assert {(r.chat_id, r.entry_id): r.depth for r in QUERIES["recursion_closure"](spark, d).collect()} == {("c", i + 1): i for i in range(7)}


def test_near_duplicates_at_the_reference_threshold(spark, tables):
    word = lambda i: f"word{chr(97 + i % 26)}{chr(97 + i // 26)}"
    texts = [" ".join(map(word, range(a, b))) for a, b in ((0, 60), (20, 80), (90, 150))]  # the first two share 40 of 80
    d = tables(book_entries=_book([([], t) for t in [*texts, "too short", None]]))
    assert {r.entry_id: (r.class_id, r.links) for r in QUERIES["near_duplicates"](spark, d).collect()} == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 0), 4: (4, 0)}


def test_pooled_cosine_of_all_searches(spark, tables):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(301, 8)).astype("float32")
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(x)]
    d = tables(embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    c = x.astype(float) - x.astype(float).mean(0)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    want = {}
    for q in (0, 100, 200, 300):
        for label in range(4):
            at = np.arange(label, 301, 4)
            best = at[(c[at] @ c[q]).argmax()]
            want[q, label] = (int(best), round(float(c[best] @ c[q]), 5))
    got = {(r.query_id, r.label): (r.vec_id, round(r.score, 5)) for r in QUERIES["pooled_cosine_all"](spark, d).collect()}
    assert got == want
    assert {(0, r.label): (r.vec_id, round(r.score, 5)) for r in QUERIES["pooled_cosine"](spark, d).collect()} == {k: v for k, v in want.items() if k[0] == 0}


def test_fingerprints_tell_contents_apart(spark, tables):
    rows = [(i, w, u, [], [], 0, None, c, None, None, None, dt.datetime(2025, 1, 1)) for i, (w, u, c) in enumerate([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("b", 1, "z")])]
    d = tables(book_entries=(rows, ENTRY))
    got = {r.world: r for r in QUERIES["book_fingerprints_all"](spark, d).collect()}
    assert got["a"].entries == got["b"].entries == 2 and got["a"].fingerprint != got["b"].fingerprint

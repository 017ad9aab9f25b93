"""Stages that keep what is held of one book: the same as the rules say, for books cut into shares too."""

import random

import numpy as np

from lorelake.operators import activation, matching
from lorelake.plans import smartkeys as S
from lorelake.plans.queries import QUERIES

from .test_whole_jobs import MESSAGE, _book, tables  # noqa: F401


def test_an_expression_is_asked_wherever_it_may_hold_without_its_terms(spark, tables):  # noqa: F811
    book = [(["? /l[ao]ntern/ OR bridge"], "a"), (["? bridge & gate"], "b"), (["amber-glass", "amber-glass"], "c")]
    said = [(1, "c", "A", True, False, "1709251200000", "a lantern"), (2, "c", "A", True, False, "1709251200001", "amber glass, amber-glass")]
    d = tables(book_entries=_book(book), chats=([("c", "w")], "chat_id string, world_info string"), chat_messages=(said, MESSAGE))
    assert {(r.entry_id, r.hits, r.score) for r in QUERIES["keyword_activation"](spark, d).collect()} == {(0, 1, 1.0), (2, 1, 1.606136)}


def test_pooled_is_match_units_summed(spark):
    rng = random.Random(5)
    words = ["amber", "birch", "cedar-wood", "Dahlia", "elder"]
    entries = [(w, i, rng.sample([*words, "? amber::2 & birch", "/b[iy]rch/", "? -elder cedar"], 3), rng.choice([[], ["elder"]]), rng.randrange(4), rng.random() < 0.3, rng.random() < 0.3) for i, w in enumerate("vvvwww")]
    df = spark.createDataFrame(entries, "world string, entry_id long, key array<string>, keysecondary array<string>, selective_logic int, case_sensitive boolean, whole_words boolean")
    texts = [(str(i), f"c{i % 40}", "vw"[i % 2], " ".join(rng.choices([*words, "cedar wood", "elders"], k=5))) for i in range(400)]
    segs = spark.createDataFrame(texts, "seg_id string, chat_id string, world string, text string")
    got = {(r.chat_id, r.entry_id): (round(r.score, 9), r.hits, r.log_weight) for r in matching.fired(df, segs).collect()}
    want = matching.keyword_scores(matching.match_units(df, segs), segs.select("seg_id", "chat_id"))
    assert got == {(r.chat_id, r.entry_id): (round(r.score, 9), r.hits, r.log_weight) for r in want.collect()} and len(got) > 50


def test_shares_of_a_large_book_have_all_of_its_keys(spark, monkeypatch):
    from lorelake import session

    held = spark.createDataFrame([("w", i) for i in range(7)], "world string, k int")
    rows = spark.createDataFrame([("w", f"c{i % 50}") for i in range(1000)] + [("v", "x")], "world string, chat_id string")
    out = session.beside(held, rows, "world", "chat_id", least=1).collect()
    shares = {r.share for r in out if r.world == "w"}
    assert len(shares) > 1 and sum(r.second for r in out) == 1001 and sorted((r.share, r.k) for r in out if not r.second) == [(s, k) for s in sorted(shares) for k in range(7)]
    assert all(len({r.share for r in out if r.chat_id == c}) == 1 for c in {r.chat_id for r in out if r.second})


def test_admitted_is_the_walk():
    from lorelake.operators import delivery, ranking

    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(0, 60))
        tokens, vector = rng.integers(0, 90, n), rng.random(n) < 0.5
        caps = delivery.Caps(tokens=int(rng.choice([0, 50, 400])), vector=int(rng.choice([0, 3])))
        walk = delivery._Walk(caps)
        want = [i for i in range(n) if walk.judge(int(tokens[i]), "dynamic", bool(vector[i]), False, "w", 0)[0]]
        assert ranking.admitted(tokens, vector, caps) == want


def test_delivery_writes_no_pairs(spark, tables, monkeypatch):  # noqa: F811
    from lorelake.plans import queries

    written, stored = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df, label, **k: written.append(label) or stored(df, label, **k))
    book = [(["amber"], f"amber {'x' * i}") for i in range(30)] + [([], "no key, but it counts for frequencies"), (["amber"], None)]
    d = tables(book_entries=_book(book), chats=([("c", "w")], "chat_id string, world_info string"), chat_messages=([(1, "c", "A", True, False, "1709251200000", "some amber")], MESSAGE))
    rows = QUERIES["activate_rank_deliver"](spark, d).collect()
    assert set(written) == {"segments", "queries"} and rows and [r.prompt_order for r in sorted(rows, key=lambda r: r.entry_id)] == list(range(99_000, 99_000 + len(rows)))


def test_reach_is_the_levels_of_a_loop():
    rng = random.Random(9)
    for _ in range(100):
        waits = {i: rng.choice([0, 0, 0, 2, 4]) for i in range(12)}
        edges = list({(a, b) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(20)) if a != b})
        seeds, steps = rng.sample(range(14), 3), rng.choice([0, 0, 1, 3])
        want = dict.fromkeys(seeds, 0)
        depth = 0
        while not steps or depth < steps:
            depth += 1
            new = {b for a, b in edges if a in want and waits[b] <= depth} - set(want)
            if not new and depth >= max(waits.values()):
                break
            want |= dict.fromkeys(new, depth)
        reach = activation._Reach()
        reach.edges = [(a, np.array([b]), np.array([waits[b]])) for a, b in edges]
        for _ in range(2):
            found, at = reach.levels(seeds, steps)
            assert dict(zip(found.tolist(), at.tolist())) == want and len(found) == len(want)
            assert reach.bits is not None or _
            reach.bits = None  # the same with few edges


def test_links_of_a_book_in_blocks(spark, tables, monkeypatch):  # noqa: F811
    from lorelake.operators import audit

    rng = random.Random(2)
    words = [f"word{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    texts = [" ".join(rng.sample(words[k * 12 : k * 12 + 36], 32)) for k in (0, 1, 2) for _ in range(15)]
    d = tables(book_entries=_book([([], t) for t in [*texts, texts[0]]]))
    whole = {r.entry_id: (r.class_id, r.links) for r in QUERIES["near_duplicates"](spark, d).collect()}
    monkeypatch.setattr(audit, "BLOCK", 9)
    assert {r.entry_id: (r.class_id, r.links) for r in QUERIES["near_duplicates"](spark, d).collect()} == whole
    sets = [set(t.split()) for t in texts]
    near = [sum(len(a & b) / len(a | b) >= audit.DUPE_MIN for b in sets) - 1 for a in sets]
    assert [whole[i][1] for i in range(len(texts))] == near and whole[45] == whole[0]


def test_flags_read_the_keys_once(spark, monkeypatch):
    from lorelake.operators import audit

    calls, key_table = [], matching.key_table
    monkeypatch.setattr(matching, "key_table", lambda e: calls.append(1) or key_table(e))
    rows = [("w", i, [k], c) for i, (k, c) in enumerate([("amber", "amber, amber-glass"), ("amber-glass", "amber glass"), ("unsaid", None), ("/it's/", "it’s"), ("? amber::3 & glass", "x")])]
    entries = spark.createDataFrame(rows, "world string, entry_id long, key array<string>, content string")
    chat = spark.createDataFrame([(i, t) for i, t in enumerate(["amber", "chambers", "chamber", "no"])], "msg_id long, mes string")
    got = {r.key: (r.flag, r.severity, r.df, r.chat_rate) for r in audit.flags(entries, chat).collect()}
    assert len(calls) == 1 and got["amber"] == ("substring", "moderate", 2, 0.75) and {k: r[0] for k, r in got.items()} == {"amber": "substring", "unsaid": "unattested", "/it's/": "regex orthography"}
    book = {r.key: (r.df, r.total, r.typed) for r in audit.book_counts(entries).collect()}
    assert book == {"amber": (2, 3.0, 3), "amber-glass": (2, 2.0, 1), "unsaid": (0, 0.0, 0), "/it's/": (0, 0.0, 0), "? amber::3 & glass": (2, book["? amber::3 & glass"][1], 0)}

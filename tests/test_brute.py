"""Queries that SQL can't express, against plain Python over the whole smallest tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorelake.functions import text as T
from lorelake.operators import audit, matching
from lorelake.plans import smartkeys as S
from lorelake.plans.queries import CFG, QUERIES

from .compare import DATA, no_tables

pytestmark = no_tables


@pytest.fixture(scope="module")
def tables():
    import pyarrow.parquet as pq

    return {t: pq.read_table(f"{DATA}/{t}.parquet").to_pylist() for t in ("book_entries", "chats", "embeddings", "eval_items")}


def _live(spark):
    from lorelake.operators.scenes import usable_messages

    return usable_messages(spark.read.parquet(f"{DATA}/chat_messages.parquet")).select("chat_id", "msg_id", "t", "name", "mes").collect()


def _kind(k):
    return "smart" if k.startswith("?") else "regex" if S.REGEX_KEY.match(k) else "literal"


def _keys(e):
    return [k.strip() for k in e["key"] or () if (k or "").strip()]


def _current(tables):
    last = {}
    for e in sorted(tables["book_entries"], key=lambda e: (e["saved_at"], e["entry_id"])):
        last[e["world"], e["uid"]] = e
    return list(last.values())


def _windows(spark, tables):
    """{chat: (world, segments)} of the last messages' paragraphs."""
    world = {c["chat_id"]: c["world_info"] for c in tables["chats"] if c["world_info"]}
    held = defaultdict(list)
    for m in sorted(_live(spark), key=lambda m: (m.t, m.msg_id)):
        held[m.chat_id].append(f"{m.name}: {m.mes}" if m.name else m.mes)
    return {c: (world[c], T.segments(ms[-CFG.message_depth :], "paragraph")) for c, ms in held.items() if c in world}


def _tree(e, k):
    return S.gated(k, [x for x in e["keysecondary"] or ()], e["selective_logic"], False, False)


def _activation(spark, tables):
    by_world = defaultdict(list)
    for e in _current(tables):
        if not e["disable"] and not e["constant"]:
            by_world[e["world"]] += [(e, k) for k in dict.fromkeys(_keys(e)) if not S.fatal(k)]
    out = {}
    for chat, (world, segs) in _windows(spark, tables).items():
        segs = [S.Segment(s) for s in segs]
        units, keys, weight = defaultdict(lambda: [0.0, 0]), defaultdict(set), defaultdict(lambda: -math.inf)
        for e, k in by_world[world]:
            tree = _tree(e, k)
            names = {id(n): i for i, n in enumerate(S.walk(tree))}
            for seg in segs:
                r = S.evaluate(tree, seg)
                if r.matched:
                    keys[e["entry_id"]].add(k)
                    weight[e["entry_id"]] = max(weight[e["entry_id"]], r.log_weight)
                    for what, mass, n in r.units or [(None, 0.0, 1)]:
                        u = units[e["entry_id"], k, names.get(what, -1) if e["keysecondary"] or k.startswith("?") else -1]
                        u[0] += mass
                        u[1] += n
        score = Counter()
        for (i, _, _), (mass, n) in units.items():
            score[i] += mass / n * (1 + math.log(1 + (n - 1) / 1.2))
        for i in keys:
            out[chat, i] = (score[i], len(keys[i]), weight[i])
    return out


def keyword_activation(spark, tables, rows):
    want = _activation(spark, tables)
    assert {(r.chat_id, r.entry_id) for r in rows} == set(want)
    for r in rows:
        assert (r.score, r.log_weight) == pytest.approx((want[r.chat_id, r.entry_id][0], want[r.chat_id, r.entry_id][2]), abs=1e-5) and r.hits == want[r.chat_id, r.entry_id][1]


def recursion_closure(spark, tables, rows):
    entries = [e for e in _current(tables) if not e["disable"] and not e["constant"]]
    reach = defaultdict(set)
    for a in entries:
        if a["content"] is None:
            continue
        segs = [S.Segment(p) for p in T.segments([a["content"]], "paragraph")]
        for b in entries:
            if b["world"] == a["world"] and b is not a and any(S.evaluate(_tree(b, k), s).matched for k in _keys(b) if not S.fatal(k) for s in segs):
                reach[a["entry_id"]].add(b["entry_id"])
    want = {}
    per = defaultdict(set)
    for chat, i in _activation(spark, tables):
        per[chat].add(i)
    for chat, front in per.items():
        depth, seen = 0, set()
        while front:
            want |= {(chat, i): depth for i in front}
            seen |= front
            front = set().union(*(reach[i] for i in front)) - seen
            depth += 1
    assert {(r.chat_id, r.entry_id): r.depth for r in rows} == want


def activate_rank_deliver(spark, tables, rows):
    fired, content = _activation(spark, tables), {e["entry_id"]: e["content"] or "" for e in tables["book_entries"]}
    spent, order = Counter(), defaultdict(list)
    for r in rows:
        assert (r.chat_id, r.entry_id) in fired and r.e_credit >= CFG.relevance_cutoff - 1e-6
        spent[r.chat_id] += math.floor(len(content[r.entry_id]) / 4.91 + 0.5)
        order[r.chat_id].append((r.prompt_order, r.walk))
    assert rows and max(spent.values()) <= 2000
    for places in order.values():
        assert [p for p, _ in sorted(places)] == list(range(99_000, 99_000 + len(places))) and len({w for _, w in places}) == len(places)


def _chat_counts(spark, tables):
    segs = [S.Segment(m.mes) for m in _live(spark)]
    keys = {k for e in tables["book_entries"] for k in _keys(e) if not S.fatal(k)}
    return {k: sum(bool(S.evaluate(S.leaf(k), s).matched) for s in segs) for k in keys}, len(segs)


def key_chat_counts_all(spark, tables, rows):
    want, n = _chat_counts(spark, tables)
    assert {(r.key, r.kind): (r.messages_with, r.messages) for r in rows} == {(k, _kind(k)): (c, n) for k, c in want.items()}


def match_rate_bands(spark, tables, rows):
    want, _ = _chat_counts(spark, tables)
    band = lambda n: "0" if not n else "1-3" if n <= 3 else "4-20" if n <= 20 else "21-100" if n <= 100 else ">100"
    assert {r.band: (r.rows, r.keys) for r in rows} == {b: (n, n) for b, n in Counter(map(band, want.values())).items()}


def key_book_counts_all(spark, tables, rows):
    texts = defaultdict(list)
    for e in tables["book_entries"]:
        if e["content"]:
            texts[e["world"]].append(S.Segment(e["content"]))
    want = {}
    for w, k in {(e["world"], k) for e in tables["book_entries"] for k in _keys(e) if not S.fatal(k)}:
        found = [r for s in texts[w] if (r := S.evaluate(S.leaf(k), s)).matched]
        want[w, k] = (len(found), sum(float(r.boost or 1) for r in found)) if _kind(k) != "literal" else None
    for r in rows:
        if want[r.world, r.key] is not None:
            assert (r.df, r.total) == pytest.approx(want[r.world, r.key])
    assert {(r.world, r.key) for r in rows} == set(want)


def key_alerts(spark, tables, rows):
    want = Counter()
    for e in tables["book_entries"]:
        for k in _keys(e):
            alerts = S.validate(k)
            want.update((_kind(k), not any(S.ALERTS[a] == "error" for a in alerts), a) for a in alerts or (None,))
    assert {(r.kind, r.usable, r.alert): r.n for r in rows} == dict(want)


def _texts(spark):
    return [(r.msg_id, r.mes or "") for r in spark.read.parquet(f"{DATA}/chat_messages.parquet").select("msg_id", "mes").collect()]


def proximity(spark, tables, rows):
    """Both words with at most four words between, whatever their order, by places of words."""
    want = set()
    for i, t in _texts(spark):
        words = T.regex.findall(r"[\p{L}\p{N}\p{M}'’-]+", T.fold_text(T.mask_tags(t)))
        a, b = ([n for n, w in enumerate(words) if x in w] for x in ("lantern", "tonight"))
        if any(abs(x - y) - 1 <= 4 for x in a for y in b):
            want.add(i)
    assert {r.msg_id for r in rows} == want


def key_excerpts(spark, tables, rows):
    got = Counter(r.row_id for r in rows)
    for i, t in _texts(spark):
        s = S.Segment(t)
        n = len(T.regex.findall(r"bridge", s.folded)) + len(T.regex.findall(r"(?:(?<![\p{L}\p{N}\p{M}'’-])|(?<=--))lantern(?:(?![\p{L}\p{N}\p{M}'’-])|(?=--))", s.folded))
        assert got[i] == n
    assert all(f"«{r.excerpt.split('«')[1].split('»')[0]}»" in r.excerpt and r.until > r.at for r in rows)


def chunk_plan(spark, tables, rows):
    want = {}
    for e in tables["book_entries"]:
        if not e["disable"] and (cs := [c.strip() for c in T.chunk_entry(e["content"]) if c.strip()]):
            want[e["entry_id"]] = (len(cs), sum(map(len, cs)))
    assert {r.entry_id: (r.n, r.chars) for r in rows} == want
    assert all(abs(sum(len(w) for w in (e["content"] or "").split()) - sum(len(w) for c in T.chunk_entry(e["content"]) for w in c.split())) <= 2 for e in tables["book_entries"])


def bm25_maxpool(spark, tables, rows):
    chunks = [(e["entry_id"], Counter(T.token_list(c))) for e in tables["book_entries"] if not e["disable"] and (e["content"] or "").strip() for c in T.chunk_entry(e["content"]) if c.strip()]
    df, size = Counter(t for _, c in chunks for t in c), [sum(c.values()) for _, c in chunks]
    mean, n = sum(size) / len(size), len(chunks)
    want = {}
    for item in tables["eval_items"]:
        best = {}
        for t in {t for t in T.token_list(item["text"]) if 0 < df[t] <= CFG.stopword_df * n}:
            for k, (e, c) in enumerate(chunks):
                if t in c:
                    best[k] = best.get(k, 0) + math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size[k] / mean))
        if best:
            want[item["item_id"]] = (len({chunks[k][0] for k in best}), max(best.values()))
    assert {r.item_id for r in rows} == set(want) and all((r.n, r.best) == pytest.approx(want[r.item_id], abs=1e-4) for r in rows)


def unreached_spellings(spark, tables, rows):
    want = set()
    for e in tables["book_entries"]:
        for k in _keys(e):
            if _kind(k) == "regex" and not S.fatal(k):
                for alt, label in T.other_spellings(k):
                    if any(S.count_key(alt, o["content"]) > S.count_key(k, o["content"]) for o in tables["book_entries"] if o["world"] == e["world"] and o["content"]):
                        want.add((e["entry_id"], k, label))
    assert {(r.entry_id, r.key, r.spelling) for r in rows} == want


def unusable_secondary(spark, tables, rows):
    want = {(e["entry_id"], k) for e in tables["book_entries"] for k in e["keysecondary"] or () if (k or "").strip() and k not in S.usable_secondary(e["keysecondary"], None, e["selective_logic"])}
    assert {(r.entry_id, r.key) for r in rows} == want


def audit_flags(spark, tables, rows):
    chats, n = _chat_counts(spark, tables)
    for r in rows:
        assert (r.flag == "unusable") == S.fatal(r.key) and r.flag in audit.FLAGS
        if r.flag == "chat common":
            assert chats[r.key] >= audit.CHAT_COMMON * n
        if r.flag == "unattested":
            assert r.df == 0 and not chats[r.key] and not T.regex.match(r"^\p{Lu}.*\s\p{Lu}\S*$", r.key)
    flagged = {(r.entry_id, r.pos) for r in rows}
    fatal = {(e["entry_id"], i) for e in tables["book_entries"] for i, k in enumerate(e["key"] or ()) if (k or "").strip() and S.fatal(k.strip())}
    assert fatal <= flagged and len(flagged) == len(rows)


def audit_severities(spark, tables, rows):
    each = Counter((r.flag, r.severity) for r in QUERIES["audit_flags"](spark, DATA).collect())
    assert {(r.flag, r.severity): r.n for r in rows} == dict(each)


def logistic_coefficients(spark, tables, rows):
    from lorelake.plans.queries import _signals

    data = np.array([(r.text, r.keys, r.label) for r in _signals(spark, DATA).collect()], float)
    x, y, beta = np.column_stack([np.ones(len(data)), data[:, :2]]), data[:, 2], np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(3), x.T @ (y - p) - 1e-6 * beta)
    assert [r.beta for r in rows] == pytest.approx(beta, abs=2e-3)


def principal_components(spark, tables, rows):
    v = np.array([e["embedding"] for e in tables["embeddings"]], float)
    c = v - v.mean(0)
    top = np.linalg.svd(c, full_matrices=False)[2][:3]
    left = np.linalg.norm(c - c @ top.T @ top, axis=1)
    want = {e["vec_id"]: x for e, x in zip(tables["embeddings"], left)}
    got = np.array([(r.left_norm, want[r.vec_id]) for r in rows])
    assert len(rows) == len(v) and np.abs(got[:, 0] - got[:, 1]).mean() < 0.01


def book_fingerprints_all(spark, tables, rows):
    live = [e for e in tables["book_entries"] if not e["disable"] and (e["content"] or "").strip()]
    assert {r.world: (r.entries, r.chars) for r in rows} == {w: (sum(e["world"] == w for e in live), sum(len(e["content"]) for e in live if e["world"] == w)) for w in {e["world"] for e in live}}
    assert len({r.fingerprint for r in rows}) == len(rows)


BRUTE = {
    f.__name__: f
    for f in (
        keyword_activation, recursion_closure, activate_rank_deliver, key_chat_counts_all, match_rate_bands, key_book_counts_all, key_alerts, proximity, key_excerpts, chunk_plan, bm25_maxpool,
        unreached_spellings, unusable_secondary, audit_flags, audit_severities, logistic_coefficients, principal_components, book_fingerprints_all,
    )
}


@pytest.mark.parametrize("name", sorted(BRUTE))
def test_brute(spark, tables, name):
    BRUTE[name](spark, tables, QUERIES[name](spark, DATA).collect())


def test_required_literals():
    for key, run in (("/l[ao]ntern[s]?/i", "ntern"), ("/(?:foo|barn)+ gate/", " gate"), ("/x{0,3}harbor|bay/", None), ("/a.b/", None), ("plain", None), ("/(?!gate)harbor/", "harbor"), ("/(har)+bor?/", "har")):
        assert S.required_literal(key) == run


def test_patterns_are_found_whatever_their_case(spark):
    texts = ["The KING’S gate", "King's", "nothing", "kin", "<b class='king'>x</b>", "ſtone"]
    segs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "seg_id string, text string")
    keys = spark.createDataFrame([("/king/i", "regex", True), ("/stone/i", "regex", True), ("? /king/i & gate", "smart", True)], "key string, kind string, usable boolean")
    want = {(k, str(i)) for k in ("/king/i", "/stone/i", "? /king/i & gate") for i, t in enumerate(texts) if S.evaluate(S.leaf(k), S.Segment(t)).matched}
    assert {(r.key, r.seg_id) for r in matching.evaluated_hits(segs, keys).collect()} == want and len(want) >= 4

from types import SimpleNamespace

from collections import Counter

import pytest

from lorelake.llm import distinctive, terms
from lorelake.llm.queries import COMMON

TEXTS = ["Gate gate GATE the", "the gаte of the", None, "", "  ", "x", "ünï ﬁre 42 a_b", "the " * 3000 + "end"]


def _messages(make):
    return make([(i, "c", True, i % 5 == 4, None, t) for i, t in enumerate(TEXTS)] + [(99, "c", True, None, None, TEXTS[0])])


def _brute(texts, vals):
    occ, rec, n = Counter(), Counter(), Counter()
    for t in texts:
        if t and t.strip():
            n["mes"] += 1
            ts = terms.terms_of(t)
            occ.update(("mes", x) for x in ts)
            rec.update({("mes", x) for x in ts})
    for v in vals:
        n["key"] += 1
        vs = terms.whole_values(v)
        occ.update(("key", x) for x in vs)
        rec.update({("key", x) for x in vs})
    return occ, rec, n


@pytest.mark.parametrize("heavy", [{}, {"mes": {"the": 0, "gate": 1}, "key": {"gate": 0}}])
def test_counts(spark, make_entries, make_messages, monkeypatch, heavy):
    monkeypatch.setattr(terms, "detect_heavy", lambda recs: heavy)
    keys = [["Gate", " gate ", "", None, "gаte"], [], None, ["The Gate"], ["Gate"]]
    entries = make_entries([(i, k, "x") for i, k in enumerate(keys)])
    kept = [t for i, t in enumerate(TEXTS) if i % 5 != 4] + [TEXTS[0]]
    occ, rec, n = _brute(kept, keys)
    rows = terms.marked_terms(terms.records(entries, _messages(make_messages)), COMMON).collect()
    assert {(r.field, r.term): (r.n_occurrences, r.n_records) for r in rows} == {k: (occ[k], rec[k]) for k in occ}
    for r in rows:
        share = r.n_records / n[r.field]
        assert r.mark == ("rare" if r.n_records == 1 else "common" if share >= COMMON[r.field] else None)


def test_flush(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(terms, "FLUSH", 3)
    batch = pa.RecordBatch.from_pydict({"field": ["mes"] * 3, "text": ["aa bb cc dd", "aa bb", "ee aa"], "vals": pa.array([None] * 3, pa.list_(pa.string()))})
    out = Counter()
    for b in terms._counter(SimpleNamespace(value={"mes": {"aa": 0}}))(iter([batch, batch])):
        for r in b.to_pylist():
            if r["term"]:
                out[r["term"]] += r["n_occurrences"]
    assert out == {"aa": 6, "bb": 4, "cc": 2, "dd": 2, "ee": 2}


def test_empty(make_entries, make_messages):
    assert terms.marked_terms(terms.records(make_entries([]), make_messages([])), COMMON).count() == 0
    assert distinctive.term_scores(distinctive.records(make_entries([]), make_messages([]))).count() == 0


def test_parsimonious_scores(make_entries, make_messages):
    entries = make_entries([(i, [], "the river and the hill and the road") for i in range(30)] + [(50, [], "the the the zorn zorn zorn"), (51, [], None), (52, [], "zorn"), (53, [], "the the the zorn zorn zorn")])
    rows = distinctive.term_scores(distinctive.records(entries, make_messages([]))).collect()
    one = {r.term: r for r in rows if r.row_id == 50}
    assert one["zorn"].score > 0.9 > 0.1 > one["the"].score and one["zorn"].tf == 3 and one["zorn"].n_records == 3
    sums = Counter()
    for r in rows:
        sums[r.row_id] += r.score
    assert all(abs(x - 1) < 1e-4 for x in sums.values())
    found = distinctive.term_scores(distinctive.records(entries, make_messages([])), min_tf=3, max_df=5).collect()
    assert {(r.row_id, r.term) for r in found} == {(50, "zorn"), (53, "zorn")}


def test_pack_round_trip():
    rows, sizes, idx, tf = distinctive.unpack(distinctive.pack([5, 2**40], [2, 1], [0, 70_000, 3], [1, 300, 2]))
    assert rows.tolist() == [5, 2**40] and sizes.tolist() == [2, 1] and idx.tolist() == [0, 70_000, 3] and tf.tolist() == [1, 300, 2]

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lorelake.llm import chunk_tree as K


def _level(c, limit=1200):
    fits = lambda units: all(len(u.strip(" \t\r\n")) <= limit for u in units)
    lines = c.split("\n")
    paragraphs, cur = [], []
    for x in [*lines, ""]:
        if x.strip(" \t\r"):
            cur.append(x)
        else:
            paragraphs.append("\n".join(cur))
            cur = []
    sentences = [s for x in lines for s in re.split(r"(?<=[.!?])[ \t\r\n]+", x)]
    for name, units in (("paragraph", paragraphs), ("line", lines), ("sentence", sentences), ("word", re.split(r"[ \t\r\n]+", c))):
        if fits(units):
            return name
    return "none"


def _check(text, limit, overlap):
    pieces, level = K.split_text(text, limit, overlap)
    assert all(e - (a - n) <= limit and n >= 0 for a, e, n in pieces)
    gaps = [text[x:y] for x, y in zip([0, *[e for _, e, _ in pieces]], [*[a for a, _, _ in pieces], len(text)])]
    assert not "".join(gaps).strip(K.BLANKS)  # only blanks fall between pieces
    for (a, e, _), (b, _, n) in zip(pieces, pieces[1:]):
        assert n == 0 or a <= b - n < e and e - (b - n) <= overlap
    assert level == (_level(text, limit) if len(text) > limit else None)
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word ", "longerword", ". ", "!\n", "\n\n", "\n \t\r\n", "\r\n", "- item ", "# Head\n", "x" * 30, "\t", "é"]), max_size=60))
def test_round_trip_and_level(parts):
    _check("".join(parts), 40, 8)


def test_real_sizes():
    rng = random.Random(3)
    text = "\n\n".join(" ".join("x" * rng.randint(2, 9) for _ in range(rng.randint(5, 260))) + "." for _ in range(40))
    pieces = _check(text, 1200, 120)
    assert sum(n > 0 for _, _, n in pieces) > len(pieces) * 0.8
    _check("y" * 5000, 1200, 120)
    _check("word " * 40_000, 1200, 120)


def test_sections_stay_together():
    text = "# A\n\n" + "a" * 20 + "\n\n# B\n\n" + "b" * 20
    pieces, level = K.split_text(text, 40, 0)
    assert [text[a:e][:3] for a, e, _ in pieces] == ["# A", "# B"] and level == "paragraph"


def test_operator(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \n" * 700, 9), (4, "short", 9), (5, "w " * 800, 9), (5, "w " * 800, 9)]
    items = spark.createDataFrame(rows, "row_id long, text string, piece int")
    assert {r.row_id for r in K.split_items(items).collect()} == {4, 5}
    assert sorted((r.row_id, r.level) for r in K.split_levels(items).collect()) == [(3, "paragraph"), (5, "word"), (5, "word")]
    assert K.split_items(items.limit(0)).count() == 0

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorelake.llm import forms

PAIRS = [
    ("Flyslytu\u0308s", "Flyslytüs"), ("fli\u200entсreѕt", "flintcrest"), ("Ｓchlüssеl", "Schlüssel"), ("a\u00a0b\u2009c\u3000d", "a b c d"),
    ("\ufb06one", "stone"), ("Hynor\u2060", "Hynor"), ("bridɡe", "bridge"), ("x² ①", "x2 1"), ("монеT", "монеТ"), ("gαte", "gate"), ("so\u00adft", "soft"), ("O女α", "O女a"),
]
KEPT = ["plain", "", "“Then…” — yes", "👩\u200d🚀 ❤\ufe0f 1\ufe0f\u20e3", "сад", "tab\tline\r\n", "½", "naïve café", "彼女は静かに", "🏴\U000e0067\U000e0062\U000e007f"]


def test_pairs():
    for odd, plain in PAIRS:
        assert forms.consistent_form(odd) == plain
        assert forms.consistent_form(plain) == plain
    for s in KEPT:
        assert forms.consistent_form(s) == s
    assert forms.consistent_form(None) is None


def _slow(s):
    """Without the shortcuts: the whole text is mapped, composed, and put into one script word by word."""
    return forms._word.sub(lambda m: forms.one_script(m.group()), unicodedata.normalize("NFC", forms.mapped_chunk(s)))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abcO а е о с х Тαό̈ñéüｅＡﬁ½²①\u00a0\u200b\u200d\ufeff👩🚀❤\ufe0f“…—#*1\n\t彼女"), max_size=24))
def test_shortcuts_change_nothing(s):
    assert forms.consistent_form(s) == _slow(s)
    assert forms.consistent_form(forms.consistent_form(s)) == forms.consistent_form(s)


def test_operator_agrees_with_kernel(spark, make_entries, make_messages):
    texts = [a for a, _ in PAIRS] + KEPT + [None, "\u200b", "e\u0301" * 5000, PAIRS[0][0]]
    entries = make_entries([(i, [t, "ok", None], t) for i, t in enumerate(texts)])
    messages = make_messages([(i, "c", True, None, None, t) for i, t in enumerate(texts)])
    want = {(f, i) for i, t in enumerate(texts) if t and forms.consistent_form(t) != t for f in ("key", "content", "mes")}
    got = [(r.field, r.row_id) for r in forms.inconsistent_values(entries, messages).collect()]
    assert set(got) == want and len(got) == len(want)
    rows = {(r.field, r.row_id, r.pos): r.form for r in forms.consistent_values(entries, messages).collect()}
    assert all(rows["mes", i, 0] == forms.consistent_form(t) and rows["key", i, 0] == forms.consistent_form(t) for i, t in enumerate(texts))


CLASSES = {"é": "é", "e\u0301": "é", "É": "É", "👩\u200d🚀": "👩\u200d🚀", "👩🚀": "👩🚀", "ﬁe\u0301": "fié", "fiẻ": "fiẻ", "\u0958": "\u0915\u093c", "ـa\u0301": "ـá"}


def test_collation_decides(spark, monkeypatch):
    chunks = spark.createDataFrame([(c,) for c in [*CLASSES, "é"]], "chunk string")
    assert {r.chunk: r.form for r in forms.form_dictionary(chunks).collect()} == CLASSES
    monkeypatch.setattr(forms, "COLLATION", "UTF8_BINARY")  # without the collation, accents that stand apart stay apart
    apart = {r.chunk: r.form for r in forms.form_dictionary(chunks).collect()}
    assert apart["e\u0301"] == "e\u0301" and apart["ﬁe\u0301"] == "fie\u0301" and apart["É"] == "É"


def test_empty(spark, make_entries, make_messages):
    e, m = make_entries([]), make_messages([])
    assert forms.inconsistent_values(e, m).count() == 0
    assert forms.consistent_values(e, m).filter(F.col("form").isNotNull()).count() == 0

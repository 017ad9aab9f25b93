from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorelake.functions import text as T
from lorelake.functions.dates import parsed_date


def test_fold_and_tokens(spark):
    rows = ["It’s “fine” — ok…", "Möbius strip-a x", None, "", "A B c’est"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    got = {r.i: (r.f, r.t) for r in df.select("i", T.fold("s").alias("f"), T.tokens("s").alias("t")).collect()}
    for i, r in enumerate(rows):
        assert got[i] == (T.fold_text(r), T.token_list(r))
    assert got[0][0] == "it's \"fine\" -- ok..." and got[1][1] == ["möbius", "strip"]


def test_variants():
    assert T.key_variants("ray-ban") == ["ray-ban", "ray ban"]
    assert T.key_variants("-ban") == ["-ban"] and T.key_variants("plain") == ["plain"]


def test_segments():
    texts = ["a\n \nb<p>c</p>d", "", "e"]
    assert T.segments(texts, "scan") == ["a\n \nb<p>c</p>d\n\ne"]
    assert T.segments(texts, "message") == [texts[0], "e"]
    assert T.segments(texts, "paragraph") == ["a", "b", "<p>c</p>", "d", "e"]


def test_drop_elements():
    assert T.drop_elements("a<x>b<x>c</x>d</x>e", "x") == "ae"
    assert T.drop_elements("a<x/>b", "x") == "ab"
    assert T.drop_elements("<p>a<x>b</p>c", "x") == "<p>a</p>c"
    assert T.drop_elements("a<x>b", ["x"]) == "a" and T.drop_elements("a<xy>b</xy>", "x") == "a<xy>b</xy>" and T.drop_elements(None, "x") == ""


def test_split_keys():
    assert T.split_keys('a, b\n/x,y/i, ? "c, d" e, /open, f') == ["a", "b", "/x,y/i", '? "c, d" e', "/open", "f"]
    assert T.split_keys("a\\,b,,c") == ["a\\,b", "c"] and T.split_keys(None) == []


def test_macros():
    m = {"{{user}}": "Ann Lee", "{{none}}": ""}
    assert T.expand_macros("{{user}}[2] of {{user}} {{what}}", m) == "Lee of Ann Lee {{what}}"
    assert T.expand_macros("{{user}}[-1]{{user}}[9]{{none}}", m) == "Lee"


def test_names():
    assert T.name_words("Then Maren reached the gate. He saw Olt.\n# Big Head Line\nName Only:") == {"maren", "olt"}
    assert T.name_density("Then Maren reached the gate.") == 20


def test_mask_keeps_places():
    s = "a<b class='x'>c<!-- d -->e < f"
    assert len(T.mask_tags(s)) == len(s) and T.mask_tags(s).split() == ["a", "c", "e", "<", "f"]


@given(st.text(st.sampled_from("ab .\n"), max_size=200), st.integers(0, 40))
def test_recursive_splitter(s, n):
    parts = T.split_recursive(s, n)
    assert "".join("".join(parts).split()) == "".join(s.split())
    assert n <= 0 or all(len(p) <= max(n, 1) for p in parts)


@given(st.lists(st.text(st.sampled_from("ab ."), min_size=1, max_size=90), max_size=8))
def test_paragraph_chunker(paragraphs):
    chunks = T.chunk_paragraphs("\n\n".join(paragraphs), 60, 15)
    assert "".join("".join(chunks).split()) == "".join("".join(paragraphs).split()) or any(". " in p for p in paragraphs)
    assert all(len(c) <= 60 + 17 for c in chunks)


def test_dates(spark):
    rows = ["2024-03-01T00:01:44.376Z", "2024-03-01@00h27m21s", "March 10, 2024 1:01am", "March 5, 2024 10:46pm", "1709537672568", "1709537672", "undefined", "", None, "0000-00-00", "March 40, 2024 1:01am"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").select("i", F.timestamp_micros(parsed_date(F.col("s"))).cast("string").alias("t"))
    got = [r.t for r in df.orderBy("i").collect()]
    assert got == ["2024-03-01 00:01:44.376", "2024-03-01 00:27:21", "2024-03-10 01:01:00", "2024-03-05 22:46:00", "2024-03-04 07:34:32.568", "2024-03-04 07:34:32", None, None, None, None, None]

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorelake.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def other(vocab):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(vocab, other, s):
    assert bpe.encode_texts([s], vocab)[0] == other.encode_ordinary(s)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aaabeénth  \n\t'-=_.漢👩0"), max_size=80))
def test_repetitive_text(vocab, other, s):
    assert bpe.encode_texts([s, s], vocab) == [other.encode_ordinary(s)] * 2


def test_long_runs_and_second_library(vocab, other):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["a" * 5000, " " * 3000, "=" * 4000, "<|endoftext|>", "don't we'll", "x" + "\u0301" * 200, "".join(rng.choices("abcdefgh ijk\n", k=20_000))]
    mine = bpe.encode_texts(texts, vocab)
    assert mine == [other.encode_ordinary(x) for x in texts]
    assert mine == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_operator(spark, monkeypatch):
    rows = [(1, None, []), (2, "", []), (3, "  \n", []), (4, "same", []), (4, "same", []), (5, "z" * 100_000, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_corpus(docs).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2][1] and got[3] == got[4] and len(got) == 6
    assert bpe.encode_corpus(docs.limit(0)).count() == 0


def test_vocabulary_given_as_a_file(spark):
    docs = spark.createDataFrame([(1, "a small text"), (2, None), (3, "")], "doc_id long, text string")
    given = {r.doc_id: r.ids for r in bpe.encode_corpus(docs, bpe.default_vocabulary()).collect()}
    assert given == {r.doc_id: r.ids for r in bpe.encode_corpus(docs).collect()} and given[2] == given[3] == []

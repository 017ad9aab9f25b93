"""Encoding of the whole corpus with a public byte-level BPE, by prefix-sharing trie traversal.

A text is cut into words by the tokenizer's own pattern. The distinct words of a block of texts are a trie, walked depth-first in
sorted order; the state of a node is the last token of the encoding of its prefix, found from the states of the shorter prefixes:
it is the one token that ends there and may follow the last token before it. So the encoding of a shared prefix is computed once.
Map-only: no shuffle, and a block bounds the memory.

Defined results: null and empty texts give an empty list; blank texts are encoded as they are; very long texts and words take
time in proportion to their length; repeated rows are encoded each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from ..session import spread

# Fixed value: the pattern that cuts a text into words before byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 4_000_000
NEVER = 1 << 60
PAIRS_KEPT = 1_000_000  # answers of may_follow that a worker remembers


class Vocabulary:
    """Tokens by rank, their splits, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._spines: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self._follows: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self._halves:
            parts = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: (self.merged(parts[i], parts[i + 1]), i))
                low = self.merged(parts[best], parts[best + 1])
                if low == NEVER:
                    break
                parts[best : best + 2] = [low]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def merged(self, a: int, b: int) -> int:
        return self.ranks.get(self.bytes_of[a] + self.bytes_of[b], NEVER)

    def spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """From the outermost byte up to the token: (token there, rank of the merge that takes it up)."""
        if (token, right) not in self._spines:
            path, t = [], token
            while True:
                path.append(t)
                if len(self.bytes_of[t]) == 1 or not (h := self.halves(t)):
                    break
                t = h[right]
            path.reverse()
            self._spines[token, right] = [(t, up) for t, up in zip(path, [*path[1:], NEVER])]
        return self._spines[token, right]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a and b together gives just a, b: no merge ever crosses their boundary.

        Walk both spines at the boundary in order of rank. At equal rank the merge further left goes first.
        """
        key = (a, b)
        if (known := self._follows.get(key)) is None:
            left, right, i, j = self.spine(a, True), self.spine(b, False), 0, 0
            while True:
                (x, x_up), (y, y_up) = left[i], right[j]
                across = self.merged(x, y)
                if across != NEVER and across < x_up and across <= y_up:
                    known = False
                    break
                if x_up == NEVER and y_up == NEVER:
                    known = True
                    break
                if x_up <= y_up:
                    i += 1
                else:
                    j += 1
            if len(self._follows) >= PAIRS_KEPT:
                self._follows.clear()
            self._follows[key] = known
        return known

    def encode_sorted(self, words: list[bytes]) -> Iterator[list[int]]:
        """Encodings of sorted distinct words: a depth-first walk of their trie, with the path's states on a stack."""
        ranks, longest, follow = self.ranks, self.longest, self._follows
        before, last = b"", [-1]  # last[i]: last token of the encoding of the first i bytes
        for w in words:
            keep, most = 0, min(len(before), len(w))
            while keep < most and before[keep] == w[keep]:
                keep += 1
            del last[keep + 1 :]
            for end in range(keep + 1, len(w) + 1):
                for start in range(max(0, end - longest), end):
                    token = ranks.get(w[start:end])
                    if token is None:
                        continue
                    if not start:
                        break
                    prior = last[start]
                    ok = follow.get((prior, token))
                    if self.may_follow(prior, token) if ok is None else ok:
                        break
                last.append(token)
            ids, end = [], len(w)
            while end:
                ids.append(last[end])
                end -= len(self.bytes_of[last[end]])
            ids.reverse()
            before = w
            yield ids


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())})


@lru_cache(maxsize=2)
def _words(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def encode_texts(texts: list[str | None], vocab: Vocabulary, pattern: str = PATTERN) -> list[list[int]]:
    """Token ids of each text; the block's distinct words are encoded once, through their trie."""
    find = _words(pattern).findall
    cut = [find(t) if t else [] for t in texts]
    distinct = sorted({w.encode("utf-8", "surrogatepass"): w for ws in cut for w in ws}.items())
    ids = dict(zip((w for _, w in distinct), vocab.encode_sorted([b for b, _ in distinct])))
    out = []
    for ws in cut:
        row: list[int] = []
        for w in ws:
            row += ids[w]
        out.append(row)
    return out


def default_vocabulary() -> str:
    """Path of byte_bpe_50k as ranks, from the installed package of public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _encode(name: str | None, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, held, chars = vocabulary(default_vocabulary() if name is None else SparkFiles.get(name)), [], 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            ids = encode_texts([t for _, t in rows], vocab, pattern)
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                held.append((doc_id, text))
                chars += len(text or "") + 1
                if chars >= BLOCK_CHARS:
                    yield out(held)
                    held, chars = [], 0
        if held:
            yield out(held)

    return run


def encode_corpus(documents: DataFrame, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids) of every row of documents (doc_id, text)."""
    name = None
    if path is not None:  # shipped to the executors; the default one is installed with the workers' Python
        documents.sparkSession.sparkContext.addFile(path)
        name = os.path.basename(path)
    return spread(documents.select("doc_id", "text")).mapInArrow(_encode(name, pattern), "doc_id long, ids array<int>")

"""Activation, ranking and delivery of each chat beside the entries of its book, in one stream: what fires is never written as rows.

A chat may fire most entries of its book, so its pairs are scored, cut and budgeted as arrays, and only what is delivered leaves the task. The rules are
those of ``matching.keyword_scores``, ``lexical.bm25``, ``relevance.score`` and ``cut``, ``delivery.layout``, ``budget`` and ``prompt_order``.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import beside
from . import delivery, matching

HELD = (*matching.KEY_COLUMNS, "uid", "content", "vectorized", "eligible")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def admitted(tokens: np.ndarray, vector: np.ndarray, caps: delivery.Caps) -> list[int]:
    """Places that ``delivery.budget`` admits of dynamic rows in walk order, under caps of tokens and vector entries alone."""
    out, at, spent, vectors = [], 0, 0, 0
    while at < len(tokens):
        fits = (tokens[at:] <= caps.tokens - spent) if caps.tokens > 0 else np.ones(len(tokens) - at, bool)
        if 0 < caps.vector <= vectors:
            fits &= ~vector[at:]
        step = int(fits.argmax())
        if not fits[step]:
            break
        at += step
        out.append(at)
        spent += int(tokens[at])
        vectors += int(vector[at])
        at += 1
    return out


class _Book(matching.BookKeys):
    """The keys, texts and chunk vectors of one book."""

    def __init__(self, embed: Callable[[list[str]], np.ndarray], chunk: tuple[str, int, int], stopword_df: float) -> None:
        super().__init__()
        self.embed, self.chunk, self.stopword_df, self.texts = embed, chunk, stopword_df, {}

    def hold(self, entry: int, *rest) -> None:
        *key, uid, content, vectorized, eligible = rest
        if key[0] is not None:
            super().hold(entry, *key)
        else:
            self.texts[entry] = (uid, content, vectorized, eligible)

    def _sort(self) -> None:
        super()._sort()
        n = len(self.entries)
        whole = [self.texts.get(e, (None, None, None, False)) for e in self.entries.tolist()]
        self.uid = np.array([-(1 << 62) if w[0] is None else w[0] for w in whole], np.int64)
        self.tokens = np.array([math.floor(len(w[1] or "") / 4.91 + 0.5) for w in whole], np.int64)
        self.vector = np.array([bool(w[2]) for w in whole], bool)
        place = {e: i for i, e in enumerate(self.entries.tolist())}
        df, self.posts, self.length = Counter(), {}, np.ones(n)
        pieces, owner, ndoc, total = [], [], 0, 0
        for entry, (_, content, _, eligible) in self.texts.items():
            if not eligible:
                continue
            terms = T.token_list(content)
            counts = Counter(terms)
            ndoc, total = ndoc + 1, total + len(terms)
            df.update(counts.keys())
            at = place.get(entry)
            for c in T.chunk_entry(content, *self.chunk):
                if c.strip():
                    pieces.append(c.strip())
                    owner.append(-1 if at is None else at)
            if at is not None:  # an entry without keys counts for frequencies and the mean only
                self.length[at] = len(terms)
                for t, k in counts.items():
                    post = self.posts.setdefault(t, (array("i"), array("i")))
                    post[0].append(at)
                    post[1].append(k)
        self.texts = {}
        self.ndoc, self.avgdl = ndoc, total / ndoc if ndoc else 0.0
        self.df = {t: k for t, k in df.items() if t in self.posts and k <= self.stopword_df * ndoc}
        self.rated: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        vectors = np.concatenate([np.asarray(self.embed(pieces[i : i + 25]), np.float32) for i in range(0, len(pieces), 25)]).astype(float) if pieces else None
        self.mean = vectors.mean(0) if pieces else None
        own = np.array(owner, np.int64)
        by = np.argsort(own, kind="stable")
        by = by[own[by] >= 0]
        self.of, self.first = np.unique(own[by], return_index=True)
        if pieces:
            self.unit = vectors[by] - self.mean
            self.norm = np.maximum(np.sqrt((self.unit * self.unit).sum(1)), 1e-12)

    def _rated(self, term: str) -> tuple[np.ndarray, np.ndarray] | None:
        if term not in self.df:
            return None
        if term not in self.rated:
            at, tf = (np.frombuffer(x, np.int32) for x in self.posts[term])
            n = self.df[term]
            idf = math.log(1 + (self.ndoc - n + 0.5) / (n + 0.5))
            self.rated[term] = (at, idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * self.length[at] / (self.avgdl or 1)))))
        return self.rated[term]

    def signals(self, query: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, text) of all entries with keys; 0 where there is none."""
        cosine, text = np.zeros(len(self.entries)), np.zeros(len(self.entries))
        if query is None:
            return cosine, text
        for term in dict.fromkeys(T.token_list(query)):
            if post := self._rated(term):
                text[post[0]] += post[1]
        if self.mean is not None and len(self.of):
            q = np.asarray(self.embed([query]), np.float32)[0].astype(float) - self.mean
            each = np.round(self.unit @ q / (self.norm * max(math.sqrt(q @ q), 1e-12)), 9)
            cosine[self.of] = np.maximum.reduceat(each, self.first)
        return cosine, text


def _credit(signals: list[np.ndarray], beta2: list[float], beta3: list[float]) -> np.ndarray:
    """``relevance.score`` of one scene's rows; signals are cosine, text and keys."""
    cosine, text, keys = signals
    z = []
    for x in (cosine, keys if text.std() <= 1e-12 < keys.std() else text, keys):
        s = x.std()
        z.append((x - x.mean()) / (s if s > 1e-12 else 1.0))
    eta = lambda b: b[0] + sum(w * v for w, v in zip(b[1:], z))
    p2 = _sigmoid(eta(beta2))
    return 0.5 * p2 + 0.5 * np.minimum(_sigmoid(eta(beta3)), p2)


def _delivered(book: Callable[[], _Book], beta2: list[float], beta3: list[float], cutoff: float, caps: delivery.Caps):
    names, kinds = ["chat_id", "entry_id", "walk", "prompt_order", "e_credit"], [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b, chat, rows in matching.scenes_by_book(batches, book, HELD, ("text", "query")):
            texts = [t for t, _ in rows if t is not None]
            if not b.keys or not texts:
                continue
            at, keys, _, log_weight = b.pooled(texts)
            if not len(at):
                continue
            cosine, text = b.signals(next((q for _, q in rows if q is not None), None))
            e = _credit([cosine[at], text[at], keys], beta2, beta3)
            kept = e >= cutoff
            at, e, log_weight = at[kept], e[kept], log_weight[kept]
            inside = (e > 0) & (e < 1) & (log_weight != 0)
            odds = np.where(inside, e, 0.5)
            rank = np.where(inside, _sigmoid(np.log(odds / (1 - odds)) + np.where(inside, log_weight, 0.0)), e)
            order = np.lexsort((b.entries[at], b.uid[at], -rank))
            at, e = at[order], e[order]
            sent = admitted(b.tokens[at], b.vector[at], caps)
            shown = sorted(sent, key=lambda i: (b.uid[at[i]], b.entries[at[i]]))
            out += [(chat, int(b.entries[at[i]]), i, 99_000 + n, float(e[i])) for n, i in enumerate(shown)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def delivered(entries: DataFrame, asked: DataFrame, segments: DataFrame, queries: DataFrame, embed: Callable[[list[str]], np.ndarray], beta2: list[float], beta3: list[float], cutoff: float, caps: delivery.Caps, stopword_df: float, chunk: tuple[str, int, int] = ("paragraph", 1750, 120)) -> DataFrame:
    """(chat_id, entry_id, walk, prompt_order, e_credit) of the entries each chat gets.

    entries are all of the books, asked those whose keys count; segments (world, chat_id, text) are what keys are looked for in, queries (world, chat_id, query) what
    entries are ranked against by similarity and BM25.
    """
    live = ~F.coalesce("disable", F.lit(False)) & (F.trim(F.coalesce("content", F.lit(""))) != "")  # as scenes.eligible
    texts = entries.select("world", "entry_id", "uid", "content", "vectorized", live.alias("eligible"))
    held = matching.usable_keys(asked).unionByName(texts, allowMissingColumns=True)
    said = segments.select("world", "chat_id", "text").unionByName(queries.select("world", "chat_id", "query"), allowMissingColumns=True)
    book = lambda: _Book(embed, chunk, stopword_df)
    return beside(held, said, "world", "chat_id").mapInArrow(_delivered(book, beta2, beta3, cutoff, caps), "chat_id string, entry_id long, walk int, prompt_order int, e_credit double")

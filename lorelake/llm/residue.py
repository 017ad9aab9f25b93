"""Template residue and error-page text, by retrieval of labelled exemplars and TF-IDF containment over passage windows.

Labelled exemplars (residue, or text that only tells of such things) form an inverted index term -> exemplars. A document is cut into
passages (lines and sentences, and runs of them that follow each other). A passage retrieves the exemplars with which it shares most weight;
its containment is the TF-IDF weight of its terms that the best NEAREST of them hold, over the weight of all its terms. A document is
excluded if some passage is contained in residue to COVER, with evidence enough: terms in common of weight EVIDENCE, or an exemplar that is
nearly whole in it (an unfilled slot is one). What only names a notice in a sentence of its own is contained to a lesser degree. A passage
that is contained at least as well in telling exemplars, slots aside, isn't residue.

Terms are words in lower case; numbers are one term, signs of letters and digits together (ids, paths) are none. One token stands for each form of
an unfilled slot (``{{..}}``, ``${..}``, ``%..%`` and so on) whatever name it holds, one for a word that follows itself four times or more, one for a run of
neighbouring keys; the macros ``{{user}}`` and ``{{char}}`` are words. Weights are logarithms of the share of documents that lack a term, smoothed at one in a thousand,
so that they don't depend on the size of the collection; terms of no exemplar weigh as those in one of two hundred documents.

Defined results: null, empty and blank texts are no cases; repeated rows are judged each; very long lines are cut into passages of
at most PASSAGE_TERMS terms; of equal containments the first passage counts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .forms import consistent_form
from .residue_exemplars import RESIDUE, TELLING

COVER = 0.7  # share of a passage's weight that residue exemplars must hold
WHOLE = 0.8  # share of an exemplar's weight that counts as nearly whole
NEAREST = 6  # exemplars that may share a passage
EVIDENCE = 10.0  # weight in common that makes up for an exemplar that isn't whole: two terms of one document in a few hundred
PASSAGE_TERMS = 60
MOST_EXEMPLARS = 20_000

# The written forms of an unfilled slot, each with its token. The macros user and char are ordinary chat.
SLOTS = [
    (re.compile(r"\[\s*insert\b[^\]\n]*\]", re.I), " slot:insert "),
    (re.compile(r"\[\s*your\b[^\]\n]*\bhere\s*\]", re.I), " slot:your "),
    (re.compile(r"<\s*[\w. ]+\bgoes here\s*>", re.I), " slot:goes "),
    (re.compile(r"<%=?[^%\n]+%>"), " slot:erb "),
    (re.compile(r"\{\{\s*(?:user|char)\s*\}\}", re.I), " macro "),
    (re.compile(r"\{\{[^{}\n]+\}\}"), " slot:curly "),
    (re.compile(r"\$\{[^{}\n]+\}"), " slot:dollar "),
    (re.compile(r"\{\d{1,2}\}"), " slot:number "),
    (re.compile(r"\[\[[a-z][a-z0-9_. ]*\]\]"), " slot:square "),
    (re.compile(r"%[A-Z][A-Z0-9_.]+%"), " slot:percent "),
    (re.compile(r"##[A-Z][A-Z0-9_. ]+##"), " slot:hash "),
    (re.compile(r"(?<!\w)__[A-Z][A-Z0-9_. ]*?__(?!\w)"), " slot:under "),
    (re.compile(r"<<[\w. ]+>>"), " slot:angle "),
    (re.compile(r"@@[\w.]+@@"), " slot:at "),
    (re.compile(r"\bTODO\s*:|\b(?:TBD|TBA|TBC|FIXME|XXX+)\b"), " slot:todo "),
]
SLOT_SIGNS = re.compile(r"[\[{<%#$]|TODO|TB[ACD]|FIXME|XXX|__|@@")
_term = re.compile(r"slot:[a-z]+|[^\W_]+(?:['’][^\W_]+)*")
_path = re.compile(r"(?<!\S)/\S*")
_cut = re.compile(r"(?<=[.!?])\s+|\n+")
_rows = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_keys = frozenset(row[i : i + n] for row in _rows for n in range(4, 11) for i in range(len(row) - n + 1))


AGAIN = 4  # times in a row that a word is said, and is filler then


def _odd(term: str) -> str:
    """A token that isn't of letters alone: a number, an id (none), a slot, or a word with an apostrophe."""
    return "0" if term.isdigit() else "" if any(c.isdigit() for c in term) else term


def terms_in(text: str) -> list[str]:
    """Terms of a text without its slots: words in lower case, numbers as 0, runs of keys as one token, words said over and over as one."""
    if "/" in text:
        text = _path.sub(" ", text)
    terms = _term.findall(text.lower())
    terms = [x for t in terms if (x := t if t.isalpha() else _odd(t))]
    if not _keys.isdisjoint(terms):
        terms = ["slot:keys" if t in _keys else t for t in terms]
    if len(terms) - len(set(terms)) >= AGAIN - 1 and any(a == b for a, b in zip(terms, terms[1:])):
        out: list[str] = []
        for t, run in groupby(terms):
            n = sum(1 for _ in run)
            out += ["slot:again"] if n >= AGAIN and t.isalpha() and t < "\u0e00" else [t] * n  # scripts beyond that set no blanks between words
        return out
    return terms


def slotted(text: str) -> str:
    if SLOT_SIGNS.search(text):
        for form, token in SLOTS:
            text = form.sub(token, text)
    return text


def parts_of(text: str) -> list[list[str]]:
    """Terms of the lines and sentences of a text; long ones in overlapping stretches."""
    parts = []
    for p in _cut.split(slotted(text)):
        ts = terms_in(p)
        parts += [ts[i : i + PASSAGE_TERMS] for i in range(0, len(ts), PASSAGE_TERMS // 2)] if len(ts) > PASSAGE_TERMS else [ts] if ts else []
    return parts


def exemplars() -> list[tuple[bool, str]]:
    """The exemplars that come with the library, as (residue, text)."""
    return [(True, line) for line in RESIDUE.strip().splitlines()] + [(False, line) for line in TELLING.strip().splitlines()]


class ExemplarIndex:
    """Inverted index of the exemplars with weights from the corpus' document frequencies."""

    def __init__(self, labelled: list[tuple[bool, str]], df: dict[str, int], n_docs: int):
        self.residue = [label for label, _ in labelled]
        self.terms = [frozenset(terms_in(text)) for _, text in labelled]
        weigh = lambda n: log((n_docs + 1) / (n + (n_docs + 1) / 1000)) + 0.05
        self.weight = {t: max(0.05, weigh(df.get(t, 0))) for ts in self.terms for t in ts}
        self.unknown = weigh((n_docs + 1) / 200)
        self.mass = [sum(self.weight[t] for t in ts) for ts in self.terms]
        self.postings: dict[str, list[int]] = {}
        for e, ts in enumerate(self.terms):
            for t in ts:
                self.postings.setdefault(t, []).append(e)
        self.slots = frozenset(t for t in self.weight if t.startswith("slot:"))
        most = max(self.weight.values(), default=1.0)
        self.least = COVER * self.unknown / (COVER * self.unknown + (1 - COVER) * most)  # share of a passage's terms that must be in exemplars for COVER
        self.vocabulary = frozenset(t for label, ts in zip(self.residue, self.terms) if label for t in ts)

    def judge(self, text: str | None) -> tuple[bool, float, int]:
        """(residue, containment, exemplar) of a text, by its best passage."""
        top = (False, 0.0, -1)
        if not text:
            return top
        parts = parts_of(consistent_form(text))
        # a run's containment is a mean of its parts', so it needs a part that the residue vocabulary holds to COVER, or a slot
        known = self.weight.__contains__
        slotted_ = [not self.slots.isdisjoint(p) for p in parts]
        seeds = [i for i, p in enumerate(parts) if slotted_[i] or sum(map(known, p)) >= self.least * len(p) and self.share(p, self.vocabulary) >= COVER]
        if not seeds:
            return top
        held = [self.masses(p, self.vocabulary) for p in parts]
        for i in seeds:
            for lo in range(max(0, i - 3), i + 1):
                some = total = 0.0
                size, slot = 0, False
                for hi in range(lo, len(parts)):
                    some, total, size, slot = some + held[hi][0], total + held[hi][1], size + len(parts[hi]), slot or slotted_[hi]
                    if hi >= i and (slot or some >= COVER * total):
                        cover, e = self.cover([t for p in parts[lo : hi + 1] for t in p])
                        if e >= 0 and cover > top[1]:
                            top = (True, cover, e)
                            if cover >= 1.0:
                                return top
                    if size > PASSAGE_TERMS or hi - i >= 8:
                        break
        return top

    def masses(self, passage: list[str], held: frozenset[str]) -> tuple[float, float]:
        """Weight of a passage's terms that are in ``held``, and of all."""
        some = total = 0.0
        for t in passage:
            w = self.weight.get(t, self.unknown)
            total += w
            if t in held:
                some += w
        return some, total

    def share(self, passage: list[str], held: frozenset[str]) -> float:
        some, total = self.masses(passage, held)
        return some / total if total else 0.0

    def cover(self, passage: list[str]) -> tuple[float, int]:
        """(containment, exemplar) of a passage in residue; exemplar is -1 unless the passage is residue."""
        terms = frozenset(passage)
        held: dict[int, float] = {}
        for t in terms:
            for e in self.postings.get(t, ()):
                held[e] = held.get(e, 0.0) + self.weight[t]
        ranked = [e for _, e in sorted((-w, e) for e, w in held.items())]
        near = [e for e in ranked if self.residue[e]][:NEAREST]
        if not near:
            return 0.0, -1
        slot = next((e for e in ranked if self.residue[e] and len(self.terms[e]) == 1 and next(iter(self.terms[e])).startswith("slot:")), -1)
        union = frozenset().union(*(self.terms[e] for e in near))
        cover = 1.0 if slot >= 0 else self.share(passage, union)
        whole = slot if slot >= 0 else next((e for e in near if held[e] >= WHOLE * self.mass[e]), -1)
        if cover < COVER or (whole < 0 and sum(self.weight[t] for t in terms & union) < EVIDENCE):
            return cover, -1
        telling = [e for e in ranked if not self.residue[e]][:NEAREST]
        plain = [t for t in passage if not t.startswith("slot:")]
        if telling and plain:
            told = self.share(plain, frozenset().union(*(self.terms[e] for e in telling)))
            if told >= COVER - 0.1 and told >= self.share(plain, union):
                return cover, -1
        return cover, whole if whole >= 0 else near[0]


def _df(vocabulary: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        n = 0
        for b in batches:
            for text in b.column("text").to_pylist():
                n += 1
                if text:
                    df.update(vocabulary.intersection(terms_in(slotted(consistent_form(text)))))
        rows = [("", n), *df.items()]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], names=["term", "n"])

    return run


def _judge(index: ExemplarIndex) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *index.judge(t)) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.bool_(), pa.float64(), pa.int32()])], names=["doc_id", "residue", "cover", "exemplar"])

    return run


def judged(documents: DataFrame, labelled: DataFrame | list[tuple[bool, str]] | None = None) -> DataFrame:
    """(doc_id, residue, cover, exemplar) of every document (doc_id, text); exemplar is the number of the one that decided, or -1.

    ``labelled`` is a table (residue boolean, text) of at most MOST_EXEMPLARS exemplars; without it those of the library are taken. So the
    vocabulary, its document frequencies and the index are bounded; both passes over the corpus are map-only but for one count a term and task.
    """
    if isinstance(labelled, DataFrame):
        rows = labelled.select("residue", "text").dropna().orderBy("residue", "text").limit(MOST_EXEMPLARS + 1).collect()
        if len(rows) > MOST_EXEMPLARS:
            raise ValueError(f"more than {MOST_EXEMPLARS} exemplars")
        labelled = [(r.residue, r.text) for r in rows]
    labelled = labelled or exemplars()
    docs = spread(documents.select("doc_id", "text"))
    vocabulary = frozenset(t for _, text in labelled for t in terms_in(text))
    df = {r.term: r.n for r in docs.mapInArrow(_df(vocabulary), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    index = ExemplarIndex(labelled, df, df.pop("", 0))
    return docs.mapInArrow(_judge(index), "doc_id long, residue boolean, cover double, exemplar int")

"""Splitting oversized items at natural boundaries, by structure-tree packing.

A text is a tree: sections that open with a heading, paragraphs, list items, lines, sentences, words, characters. A node that
fits the limit is never opened; an oversized one is split into its children, and sibling subtrees are merged again, bottom-up,
while they fit. Each piece after the first starts with up to ``overlap`` characters of the one before, cut at a blank if
there is one. Text is sized in code points, as stored.

Defined results: null, empty and blank contents give no piece; a text within the limit is one piece as stored; a run
without a blank that exceeds the limit is cut between characters (level ``none``); very long texts take time in proportion
to their length; repeated rows are split each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1200
OVERLAP = 120
BLANKS = " \t\r\n"
LEVELS = ("section", "paragraph", "item", "line", "sentence", "word", "character")
#: the name of the level in results: sections are paragraphs, items are lines, characters have none
LEVEL_NAMES = {"section": "paragraph", "paragraph": "paragraph", "item": "line", "line": "line", "sentence": "sentence", "word": "word", "character": "none"}

_blank_lines = re.compile(r"\n(?:[ \t\r]*\n)+")
_heading = re.compile(r"#{1,6} |={2,6} ?[^=\n]+={2,6}[ \t\r]*(?:\n|$)|<h[1-6]\b", re.I)
_item = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]")
_sentence_end = re.compile(r"(?<=[.!?])[ \t\r\n]+")
_blank_run = re.compile(r"[ \t\r\n]+")
Span = tuple[int, int]


def _trim(text: str, start: int, end: int) -> Span:
    while start < end and text[start] in BLANKS:
        start += 1
    while end > start and text[end - 1] in BLANKS:
        end -= 1
    return start, end


def _split(text: str, span: Span, at: re.Pattern) -> list[Span]:
    out, start = [], span[0]
    for m in at.finditer(text, span[0], span[1]):
        out.append((start, m.start()))
        start = m.end()
    out.append((start, span[1]))
    return [s for s in (_trim(text, a, b) for a, b in out) if s[1] > s[0]]


def _paragraphs(text: str, span: Span) -> list[Span]:
    """Split at lines that are empty but for spaces, tabs and CR, also where such a line opens or closes the text."""
    return _split(text, span, _blank_lines)


def _grouped(text: str, spans: list[Span], opens: Callable[[str, int], object]) -> list[Span]:
    out: list[list[int]] = []
    for a, b in spans:
        if not out or opens(text, a):
            out.append([a, b])
        else:
            out[-1][1] = b
    return [(a, b) for a, b in out]


def children(text: str, span: Span, level: str, limit: int) -> list[Span]:
    """The nodes of a level inside a span, without the blanks at their ends."""
    if level == "section":
        return _grouped(text, _paragraphs(text, span), _heading.match)
    if level == "paragraph":
        return _paragraphs(text, span)
    lines = re.compile(r"\n")
    if level == "item":
        return _grouped(text, _split(text, span, lines), lambda t, a: _item.match(t, t.rfind("\n", 0, a) + 1))
    if level == "line":
        return _split(text, span, lines)
    if level == "sentence":
        return _split(text, span, _sentence_end)
    if level == "word":
        return _split(text, span, _blank_run)
    return [(a, min(a + limit, span[1])) for a in range(span[0], span[1], limit)]


def _pack(text: str, span: Span, depth: int, limit: int, wide: int) -> tuple[list[Span], int]:
    """Spans of the pieces, and the deepest level that had to be opened."""
    if span[1] - span[0] <= wide:
        return [span], -1
    level, out, deepest, open_end = LEVELS[depth], [], depth, False
    for child in children(text, span, level, limit if level == "character" else wide):
        if child[1] - child[0] > wide:
            inner, below = _pack(text, child, depth + 1, limit, wide)
            deepest, open_end = max(deepest, below), False
            out += inner
        elif open_end and child[1] - out[-1][0] <= limit:
            out[-1] = (out[-1][0], child[1])
        else:
            out.append(child)
            open_end = True
    return out, deepest


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], str | None]:
    """[(start, end, overlap taken from before start)] of the pieces, and the level of the finest cut; None within the limit.

    Siblings are merged up to ``limit - overlap``, so that there is room for the overlap; a node between that and ``limit`` stays
    whole and takes a shorter overlap.
    """
    if not text:
        return [], None
    if len(text) <= limit:
        return ([(0, len(text), 0)] if text.strip(BLANKS) else []), None
    start, end = _trim(text, 0, len(text))
    spans, deepest = _pack(text, (start, end), 0, limit - overlap, limit) if start < end else ([], -1)
    pieces: list[tuple[int, int, int]] = []
    for a, b in spans:
        take = 0
        if pieces:
            before, low = pieces[-1], max(pieces[-1][0], pieces[-1][1] - overlap, b - limit)
            if before[0] < low and text[low - 1] not in BLANKS and (blank := _blank_run.search(text, low, before[1])):
                low = blank.end()
            take = a - low if low < before[1] else 0
        pieces.append((a, b, take))
    return pieces, LEVEL_NAMES[LEVELS[max(deepest, 0)]]


def _pieces(limit: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = ["row_id", "piece", "start", "end", "n_overlap", "level", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row_id, text in zip(b.column("row_id").to_pylist(), b.column("text").to_pylist()):
                pieces, level = split_text(text, limit, overlap)
                rows += [(row_id, i, a, e, n, level, text[a - n : e]) for i, (a, e, n) in enumerate(pieces)]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of items (row_id, text): (row_id, piece, start, end, n_overlap, level, text).

    start and end are places in the stored text, without the overlap; level is that of the whole item's finest cut, null if uncut.
    """
    schema = "row_id long, piece int, start int, end int, n_overlap int, level string, text string"
    return items.select("row_id", "text").mapInArrow(_pieces(limit, overlap), schema)


def _levels(limit: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            levels = [split_text(t, limit, overlap)[1] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(levels, pa.string())], names=["row_id", "level"])

    return run


def split_levels(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(row_id, level) of the items longer than the limit: the finest boundary at which their tree was opened."""
    longer = items.filter(F.length("text") > limit).select("row_id", "text")
    return longer.mapInArrow(_levels(limit, overlap), "row_id long, level string")

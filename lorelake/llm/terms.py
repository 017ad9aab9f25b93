"""Frequency of every distinct value or term, by heavy-light aggregation.

A term is a maximal run of letters and digits, two characters or longer, of the consistent form in lower case. A counted
message is not hidden and neither null nor blank. The heavy terms are detected on a row sample and broadcast (at most
1/HEAVY_SHARE of them, whatever the size of the data); each task counts them exactly in local arrays. Only the remaining
terms go through a shuffle, after a count per task. Which terms are heavy changes the route, never a count.

Defined results: null texts, null arrays and null elements hold no term; blank elements are left out; an empty table gives
no rows; repeated rows count again; ties don't matter, as nothing is ranked; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored
from .forms import consistent_form

TERM = re.compile(r"[^\W_]{2,}")
HEAVY_SHARE = 1 / 2000  # of all tokens of the sample; so at most 2,000 terms a field are broadcast
SAMPLE = 0.02  # of the rows, to detect heavy terms; has no influence on the counts
FLUSH = 200_000  # distinct light terms that a task holds before it hands them on
PARTIAL = "kind string, field string, term string, n_occurrences long, n_records long"


def terms_of(text: str | None) -> list[str]:
    """All terms of a text, in order."""
    return TERM.findall(consistent_form(text).lower()) if text else []


def whole_values(values: list[str | None] | None) -> list[str]:
    """The elements of an array as whole values: consistent form, trimmed, lower case, blanks left out."""
    out = []
    for v in values or ():
        if v and (v := consistent_form(v).strip().lower()):
            out.append(v)
    return out


def counted_messages(messages: DataFrame) -> DataFrame:
    """Rows that aren't hidden and whose text is neither null nor blank."""
    return messages.filter(~F.coalesce(F.col("is_system"), F.lit(False)) & F.col("mes").rlike(r"(?U)\S"))


def records(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """(field, text, vals): the records of both fields; a message has a text, an entry an array of whole values."""
    mes = counted_messages(messages).select(F.lit("mes").alias("field"), F.col("mes").alias("text"), F.lit(None).cast("array<string>").alias("vals"))
    key = entries.select(F.lit("key").alias("field"), F.lit(None).cast("string").alias("text"), F.col("key").alias("vals"))
    return mes.unionByName(key)


def _counter(heavy: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of a task: heavy terms in an array a field, the others in a dictionary that is handed on when it grows."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "field", "term", "n_occurrences", "n_records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, dict[str, int]] = heavy.value if heavy else {}
        occ: dict[str, Counter] = {}
        rec: dict[str, Counter] = {}
        seen: Counter = Counter()
        arrays = {f: np.zeros((2, len(i)), np.int64) for f, i in ids.items()}
        for b in batches:
            said: dict[str, tuple[list[int], list[int]]] = {f: ([], []) for f in ids}
            for field, text, vals in zip(b.column("field").to_pylist(), b.column("text").to_pylist(), b.column("vals").to_pylist()):
                found = whole_values(vals) if text is None else terms_of(text)
                seen[field] += 1
                if not found:
                    continue
                if field not in occ:
                    occ[field], rec[field] = Counter(), Counter()
                known, once = ids.get(field), set(found)
                if known:
                    said[field][0].extend([known[t] for t in found if t in known])
                    said[field][1].extend([known[t] for t in once if t in known])
                    found, once = [t for t in found if t not in known], [t for t in once if t not in known]
                occ[field].update(found)
                rec[field].update(once)
            for field, both in said.items():
                for counts, places in zip(arrays[field], both):
                    counts += np.bincount(np.array(places, np.int64), minlength=len(counts))
            for field in list(occ):
                if len(occ[field]) > FLUSH:
                    o, r = occ.pop(field), rec.pop(field)
                    yield out([("light", field, t, n, r[t]) for t, n in o.items()])
        rows = [("light", field, t, n, rec[field][t]) for field, o in occ.items() for t, n in o.items()]
        rows += [("heavy", f, t, int(arrays[f][0, i]), int(arrays[f][1, i])) for f, known in ids.items() for t, i in known.items() if arrays[f][0, i]]
        rows += [("records", f, None, 0, n) for f, n in seen.items()]
        yield out(rows)

    return run


def detect_heavy(recs: DataFrame, share: float = HEAVY_SHARE, fraction: float = SAMPLE) -> dict[str, dict[str, int]]:
    """{field: {term: index}} of the terms with at least that share of a field's tokens in the sample; at most 1/share a field."""
    sums = recs.sample(fraction, seed=7).mapInArrow(_counter(None), PARTIAL).filter(F.col("term").isNotNull()).groupBy("field", "term").agg(F.sum("n_occurrences").alias("n"))
    sums = sums.join(F.broadcast(sums.groupBy("field").agg(F.sum("n").alias("total"))), "field")
    heavy: dict[str, dict[str, int]] = {}
    for r in sums.filter((F.col("n") >= 5) & (F.col("n") >= F.col("total") * share)).select("field", "term").orderBy("field", "term").collect():
        ids = heavy.setdefault(r.field, {})
        ids[r.term] = len(ids)
    return heavy


def term_counts(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field, term, n_occurrences, n_records) of every term, and (field, records) with the number of records of each field."""
    heavy_ids = recs.sparkSession.sparkContext.broadcast(detect_heavy(recs))  # at most 1/HEAVY_SHARE terms a field
    partial = stored(spread(recs).mapInArrow(_counter(heavy_ids), PARTIAL), "term-partials", ["kind"])
    sums = [F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records")]
    heavy = partial.filter(F.col("kind") == "heavy").groupBy("field", "term").agg(*sums)  # a few thousand rows a task, summed by task before
    light = partial.filter(F.col("kind") == "light").groupBy("field", "term").agg(*sums)
    sizes = partial.filter(F.col("kind") == "records").groupBy("field").agg(F.sum("n_records").alias("records"))
    return heavy.unionByName(light), sizes


def marked_terms(recs: DataFrame, common: dict[str, float]) -> DataFrame:
    """Counts of every term with its mark: ``rare`` in exactly one record, ``common`` in at least the field's share of records, else null."""
    counts, sizes = term_counts(recs)
    share = F.create_map(*[F.lit(x) for field, part in common.items() for x in (field, round(part * 1000))])
    enough = F.col("n_records") * 1000 >= F.element_at(share, F.col("field")) * F.col("records")  # in thousandths: no rounding at the edge
    mark = F.when(F.col("n_records") == 1, "rare").when(enough, "common")  # one record is rare even where it is a large share
    return counts.join(F.broadcast(sizes), "field").select("field", "term", "n_occurrences", "n_records", mark.alias("mark"))

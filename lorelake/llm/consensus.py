"""Consensus from several annotators' labels, by bipartite message passing.

Items and annotators are the two sides, verdicts the edges. An annotator's message to an item is, for each class, the logarithm of how often
it gives this verdict to items of the class, as believed from all its other items. An item's message to an annotator is its
belief in each class against the rest, from all its other annotators. Messages go back and forth until the beliefs no longer move. The
consensus is the class with the highest log-odds against the rest.

Both sides send totals and each edge takes its own part off. While the annotators number at most RATERS (counted first), the edges are
shuffled once, to one row an item, which then holds at most RATERS verdicts; each round reads these rows, sends the annotators' totals
(25 numbers each) to the tasks and gets the tasks' new totals back, so that a round shuffles no edge. An annotator with a third of all
verdicts is summed in each task first. Beyond RATERS a round is two joins and two aggregations of the edges, summed before the shuffle, with
AQE splitting skewed keys. Every round is read back from files, and the files of the round before are deleted.

After DAMP_AFTER rounds an edge moves half the way only, which ends swings between two states. If the beliefs still move after MAX_ROUNDS,
the result says so in ``settled``, and a warning is given.

Defined results: a verdict without a grade, off the scale, or of an index that the capture doesn't list is left out; of an
annotator's verdicts on an item the latest counts (equal times: the higher grade); null or empty grades and
items with no verdict give no row; one verdict is its own consensus; equal beliefs give the lower grade; repeated
rows change nothing; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, stored

CLASSES = (0, 1, 2, 3, 4)
TOLERANCE = 1e-4  # mean change of a belief in a round
MAX_ROUNDS = 100
DAMP_AFTER = 30
SMOOTH = 0.5  # pseudo-verdicts of an annotator and class: half of them right, half spread as all verdicts are
RATERS = 20_000  # annotators whose totals (at most 4 MB) may be held by the driver and each task
STATE = "item_id long, raters array<int>, grades array<int>, p array<double>, whole array<double>, sums array<struct<id:int,p:array<double>>>"


def standing_verdicts(items: DataFrame, raters: DataFrame) -> DataFrame:
    """(item_id, rater_id, grade): each annotator's standing verdict on each item, the valid one with the latest graded_at."""
    v = items.select("item_id", "capture_id", F.explode("grades").alias("g")).select("item_id", "capture_id", F.col("g.rater").alias("rater"), F.col("g.grade").alias("grade"), F.col("g.graded_at").alias("at"))
    v = v.filter(F.col("grade").between(CLASSES[0], CLASSES[-1]))
    ids = raters.filter(F.col("rater_id").isNotNull()).groupBy("capture_id", "rater").agg(F.min("rater_id").alias("rater_id"))
    last = F.max(F.struct(F.coalesce(F.try_to_timestamp("at"), F.lit("0001-01-01").cast("timestamp")).alias("at"), "grade")).grade
    return v.join(ids, ["capture_id", "rater"]).groupBy("item_id", "rater_id").agg(last.cast("int").alias("grade"))


class Beliefs(NamedTuple):
    items: DataFrame  # item_id, n, p: the belief in each class
    annotators: DataFrame  # rater_id, grade, inside, in_all: verdicts ``grade`` and all verdicts given in each class, as believed
    rounds: int
    settled: bool


def _each(f) -> Column:
    return F.array(*[f(k) for k in CLASSES])


def _softmax(c: str) -> Column:
    exps = F.transform(c, lambda x: F.exp(x - F.array_max(c)))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda a, b: a + b))


def _against_rest(p: str) -> Column:
    """Log-odds of each class against the rest."""
    return F.transform(p, lambda x: F.log(F.greatest(x, F.lit(1e-12)) / F.greatest(1 - x, F.lit(1e-12))))


def _in_all(table: DataFrame) -> DataFrame:
    return table.withColumn("in_all", _each(lambda k: F.sum(F.get("inside", F.lit(k))).over(Window.partitionBy("rater_id"))))


def _prior(share: np.ndarray) -> np.ndarray:
    """[grade, class]: what is added to the verdicts of an annotator."""
    return SMOOTH / 2 * np.repeat(share[:, None], len(CLASSES), 1) + SMOOTH / 2 * np.eye(len(CLASSES))


def _softened(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _pass(n_raters: int, inside: np.ndarray | None, share: np.ndarray, prior: np.ndarray, blend: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One round over item rows: what the annotators lend, the items' beliefs, what the items send back; and the task's sums for the annotators.

    Without ``inside`` (the first pass) the items send the shares of their verdicts.
    """
    k = len(CLASSES)

    lists = lambda x, n: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(x.ravel()))
    sent = pa.list_(pa.struct([("id", pa.int32()), ("p", pa.list_(pa.float64()))]))
    names = ["item_id", "raters", "grades", "p", "whole", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, moved, edges, classes, items = np.zeros((n_raters * k, k)), 0.0, 0, np.zeros(k), 0
        in_all = None if inside is None else inside.sum(1)
        for b in batches:
            if not b.num_rows:
                continue
            ids, raters, grades = b.column("item_id"), b.column("raters"), b.column("grades")
            r, g = raters.flatten().to_numpy(zero_copy_only=False).astype(np.int64), grades.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = raters.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts, item = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(sizes)), sizes)
            if inside is None:
                whole = np.add.reduceat(np.eye(k)[g], starts) / sizes[:, None]
                after = whole[item]
            else:
                p = b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                lend = np.log((inside[r, g] - p + prior[g]) / (in_all[r] - p + SMOOTH))
                every = np.add.reduceat(lend, starts) + np.log(share)
                whole, after = _softened(every), _softened(every[item] - lend)
                after = p + blend * (after - p)
                moved += float(np.abs(after - p).sum()) / k
            np.add.at(sums, r * k + g, after)
            edges, classes, items = edges + len(r), classes + whole.sum(0), items + len(sizes)
            yield pa.RecordBatch.from_arrays([ids, raters, grades, lists(after, sizes * k), lists(whole, np.full(len(sizes), k)), pa.nulls(len(sizes), sent)], names=names)
        at = np.flatnonzero(sums.any(1))
        out = [{"id": int(i), "p": sums[i].tolist()} for i in at] + [{"id": -1, "p": [moved, edges, items, *classes.tolist()]}]
        none = lambda t: pa.nulls(1, pa.list_(t))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.float64()), none(pa.float64()), pa.array([out], sent)], names=names)

    return run


def _by_items(edges: DataFrame, raters: list[str], share: np.ndarray, tolerance: float, max_rounds: int) -> Beliefs:
    spark, prior, inside, k = edges.sparkSession, _prior(share), None, len(CLASSES)
    index = F.broadcast(spark.createDataFrame(list(enumerate(raters)), "r int, rater_id string"))
    verdicts = F.array_sort(F.collect_list(F.struct("r", F.col("grade").cast("int").alias("g"))))
    items = edges.join(index, "rater_id").groupBy("item_id").agg(verdicts.alias("v"))
    now = items.select("item_id", F.col("v.r").alias("raters"), F.col("v.g").alias("grades"), F.array().cast("array<double>").alias("p"))
    settled, rounds = False, 0
    for rounds in range(max_rounds + 1):
        rows = now.filter("sums IS NULL" if rounds else "true").select("item_id", "raters", "grades", "p")
        now = stored(rows.mapInArrow(_pass(len(raters), inside, share, prior, 0.5 if rounds > DAMP_AFTER else 1.0), STATE), "beliefs", instead=now if rounds else None)
        parts = now.filter("sums IS NOT NULL").select(F.explode("sums").alias("s")).groupBy("s.id")
        inside, total = np.zeros((len(raters) * k, k)), np.zeros(3 + k)
        for row in parts.agg(*[F.sum(F.get("s.p", F.lit(i))) for i in range(3 + k)]).collect():  # at most 5 rows an annotator
            if row[0] < 0:
                total = np.array(row[1:])
            else:
                inside[row[0]] = row[1 : 1 + k]
        inside = inside.reshape(-1, k, k)
        if not total[1]:
            settled = True
            break
        if rounds:
            if settled := bool(total[0] / total[1] < tolerance):
                break
            share = np.maximum(total[3:] / total[2], 1e-6)
    rows = [(raters[r], g, inside[r, g].tolist(), inside[r].sum(0).tolist()) for r in range(len(raters)) for g in CLASSES if inside[r, g].any()]
    table = spark.createDataFrame(rows, "rater_id string, grade int, inside array<double>, in_all array<double>")
    state = now.filter("sums IS NULL")
    return Beliefs(state.select("item_id", F.size("raters").cast("long").alias("n"), F.col("whole").alias("p")), table, rounds, settled)


def _by_joins(edges: DataFrame, share: np.ndarray, tolerance: float, max_rounds: int) -> Beliefs:
    prior = _prior(share).tolist()
    weight = _each(lambda k: F.element_at(F.array(*[F.lit(prior[g][k]) for g in CLASSES]), F.col("grade") + 1))
    lend = _each(lambda k: F.log((F.get("inside", F.lit(k)) - F.get("p", F.lit(k)) + F.get(weight, F.lit(k))) / (F.get("in_all", F.lit(k)) - F.get("p", F.lit(k)) + SMOOTH)))
    votes = edges.groupBy("item_id").agg(_each(lambda k: F.avg((F.col("grade") == k).cast("double"))).alias("p"))
    sent = stored(edges.join(votes, "item_id").select("item_id", "rater_id", "grade", "p"), "sent")
    totals = lambda: _in_all(sent.groupBy("rater_id", "grade").agg(_each(lambda k: F.sum(F.get("p", F.lit(k)))).alias("inside")))
    table, items, settled, rounds = stored(totals(), "annotators"), None, False, 0
    for rounds in range(1, max_rounds + 1):
        lent = sent.join(table, ["rater_id", "grade"]).select("item_id", lend.alias("lend"))
        every = lent.groupBy("item_id").agg(_each(lambda k: F.sum(F.get("lend", F.lit(k))) + F.lit(float(np.log(share[k])))).alias("all"), F.count(F.lit(1)).alias("n"))
        items = stored(every.select("item_id", "all", "n", _softmax("all").alias("whole")), "items", instead=items)
        back = sent.join(items.select("item_id", "all"), "item_id").join(table, ["rater_id", "grade"])
        back = back.withColumn("rest", F.zip_with("all", lend, lambda a, b: a - b)).withColumn("target", _softmax("rest"))
        blend = 0.5 if rounds > DAMP_AFTER else 1.0
        back = back.withColumn("after", F.zip_with("target", "p", lambda a, b: b + F.lit(blend) * (a - b)))
        moved = F.aggregate(F.zip_with("after", "p", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b) / len(CLASSES)
        sent = stored(back.select("item_id", "rater_id", "grade", F.col("after").alias("p"), moved.alias("moved")), "sent", instead=sent)
        table = stored(totals(), "annotators", instead=table)
        settled = (sent.agg(F.avg("moved")).first()[0] or 0.0) < tolerance
        now = items.agg(*[F.avg(F.get("whole", F.lit(k))).alias(f"c{k}") for k in CLASSES]).first()
        if settled or now.c0 is None:
            settled = True
            break
        share = np.maximum([now[f"c{k}"] for k in CLASSES], 1e-6)
    dropped(sent)
    return Beliefs(items.select("item_id", "n", F.col("whole").alias("p")), table, rounds, settled)


def pass_messages(edges: DataFrame, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS, most: int = RATERS) -> Beliefs:
    """Messages between the items and annotators of edges (item_id, rater_id, grade) until they move by less than ``tolerance`` in the mean."""
    counts = {r.grade: r["count"] for r in edges.groupBy("grade").count().collect()}  # at most one row a class
    total = sum(counts.values())
    share = np.array([(counts.get(k, 0) + 1) / (total + len(CLASSES)) for k in CLASSES])
    raters = sorted(r.rater_id for r in edges.select("rater_id").distinct().limit(most + 1).collect())
    out = _by_items(edges, raters, share, tolerance, max_rounds) if len(raters) <= most else _by_joins(edges, share, tolerance, max_rounds)
    if not out.settled:
        warnings.warn(f"the beliefs still move after {out.rounds} rounds", stacklevel=2)
    return out


def consensus(items: DataFrame, raters: DataFrame) -> DataFrame:
    """(item_id, grade, belief, agreement, n_raters, disputed, settled) of every item with a standing verdict.

    agreement is the share of the item's annotator pairs that gave the same grade (null with one annotator).
    """
    edges = stored(standing_verdicts(items, raters), "verdicts")
    out = pass_messages(edges)
    n = F.count(F.lit(1))
    same = [F.sum((F.col("grade") == k).cast("double")) for k in CLASSES]
    pairs = sum((s * (s - 1) for s in same), F.lit(0.0)) / F.nullif(n * (n - 1), F.lit(0))
    votes = edges.groupBy("item_id").agg(n.alias("n_raters"), pairs.alias("agreement"), (F.min("grade") != F.max("grade")).alias("disputed"))
    odds = _against_rest("p")
    best = F.array_position(odds, F.array_max(odds)).cast("int") - 1
    return out.items.join(votes, "item_id").select("item_id", best.alias("grade"), F.array_max("p").alias("belief"), "agreement", "n_raters", "disputed", F.lit(out.settled).alias("settled"))


def reliability(items: DataFrame, raters: DataFrame) -> DataFrame:
    """(rater_id, n_verdicts, reliability, kind): the share of an annotator's verdicts that the beliefs from all others bear out."""
    table = pass_messages(stored(standing_verdicts(items, raters), "verdicts")).annotators
    kinds = raters.filter(F.col("rater_id").isNotNull()).groupBy("rater_id").agg(F.max(F.lower("kind")).alias("kind"))
    in_all = F.first(F.aggregate("in_all", F.lit(0.0), lambda a, b: a + b))
    sums = table.groupBy("rater_id").agg(F.round(in_all).cast("long").alias("n_verdicts"), (F.sum(F.get("inside", F.col("grade"))) / in_all).alias("reliability"))
    return sums.join(kinds, "rater_id", "left").select("rater_id", "n_verdicts", "reliability", "kind")

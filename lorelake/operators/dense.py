"""Dense ranking: centroids, centred cosine, pooling, top-k search, principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_dimension(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has ``dim`` numbers; null and misfit vectors go."""
    return vectors.filter(F.size(vector) == dim)


def corpus_mean(vectors: DataFrame, vector: str = "embedding", by: list[str] | None = None) -> DataFrame:
    """([by,] mean): the mean vector, from one partial aggregate a dimension."""
    keys = by or []
    dims = vectors.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return dims.groupBy(*keys).agg(mean.alias("mean")) if keys else dims.agg(mean.alias("mean"))


def centroid(vectors: DataFrame, subset: Column, vector: str = "embedding") -> DataFrame:
    """(mean) of the rows of the subset, or of all rows if the subset is empty."""
    some, full = corpus_mean(vectors.filter(subset), vector).withColumnRenamed("mean", "some"), corpus_mean(vectors, vector)
    return full.join(F.broadcast(some), F.lit(True), "left").select(F.when(F.size("some") > 0, F.col("some")).otherwise(F.col("mean")).alias("mean"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length or the sizes differ."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def centred(v: Column, mean: Column) -> Column:
    return F.zip_with(v, mean, lambda x, m: x.cast("double") - m)


def _block_search(queries: np.ndarray, ids: np.ndarray, mean: np.ndarray | None, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries - mean if mean is not None else queries
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        best_score, best_id = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0, np.int64)
        for b in batches:
            v = b.column(1)
            fit = np.flatnonzero(np.asarray(pc.list_value_length(v).fill_null(0)) == q.shape[1])
            if not len(fit):
                continue
            x = np.asarray(v.take(pa.array(fit)).flatten(), dtype=float).reshape(len(fit), -1)
            x = x - mean if mean is not None else x
            norm = np.linalg.norm(x, axis=1)
            scores = np.where(norm > 0, (q @ x.T) / np.where(norm > 0, norm, 1), 0.0)
            own = np.asarray(b.column(0))[fit]
            best_score, best_id = np.hstack([best_score, scores]), np.hstack([best_id, np.broadcast_to(own, scores.shape)])
            best_score = np.where(best_id == ids[:, None], -np.inf, best_score)  # a query isn't its own neighbour
            order = np.lexsort((best_id, -np.round(best_score, 9)), axis=1)[:, :k]
            best_score, best_id = np.take_along_axis(best_score, order, 1), np.take_along_axis(best_id, order, 1)
        keep = np.isfinite(best_score)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep.sum(1))), pa.array(best_id[keep]), pa.array(best_score[keep])], names=["query_id", "vec_id", "score"])

    return run


def search(queries: DataFrame, base: DataFrame, k: int, centre: bool = False, block: int = 2048, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest rows of ``base`` to each query by cosine, exact.

    The stated query set goes over the base in blocks of ``block`` vectors; each task keeps k rows a query, so what is
    shuffled is k rows a query and task. Equal scores (to nine places) are ordered by id.
    """
    mean = np.array(corpus_mean(base, vector).first().mean or [], float) if centre else None
    rows, out = [], None

    def over(part: list) -> DataFrame:
        ids, vs = np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part], float)
        return base.select(id_col, vector).mapInArrow(_block_search(vs, ids, mean, k), "query_id long, vec_id long, score double")

    for r in queries.select(F.col(id_col).cast("long"), vector).toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            out, rows = (over(rows) if out is None else out.unionByName(over(rows))), []
    if rows or out is None:
        if not rows:
            return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
        out = over(rows) if out is None else out.unionByName(over(rows))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _block_pool(queries: np.ndarray, ids: np.ndarray, mean: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries - mean if mean is not None else queries
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        best: dict = {}  # label: best score and its row, for each query
        for b in batches:
            own, v = np.asarray(b.column(0)), b.column(1)
            scores = np.zeros((len(ids), b.num_rows))  # a vector of another size or without length scores 0
            fit = np.flatnonzero(np.asarray(pc.list_value_length(v).fill_null(0)) == q.shape[1])
            if len(fit):
                x = np.asarray(v.take(pa.array(fit)).flatten(), dtype=float).reshape(len(fit), -1)
                x = x - mean if mean is not None else x
                norm = np.linalg.norm(x, axis=1)
                scores[:, fit] = np.where(norm > 0, (q @ x.T) / np.where(norm > 0, norm, 1), 0.0)
            rows: dict = {}
            for i, label in enumerate(b.column(2).to_pylist()):
                rows.setdefault(label, []).append(i)
            for label, at in rows.items():
                at = np.array(at)[np.argsort(-own[at], kind="stable")]  # equal scores: the largest id, as best_chunk
                part = scores[:, at].round(9)
                top = part.argmax(1)
                score, vec = part.max(1), own[at][top]
                if label in best:
                    s, i = best[label]
                    old = (s > score) | ((s == score) & (i > vec))
                    score, vec = np.where(old, s, score), np.where(old, i, vec)
                best[label] = score, vec
        for label, (score, vec) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([label] * len(ids), pa.int32()), pa.array(score), pa.array(vec, pa.int64())], names=["query_id", "label", "score", "vec_id"])

    return run


def pooled_search(queries: DataFrame, base: DataFrame, by: str, centre: bool = True, block: int = 2048, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, by, score, vec_id): the best row of each label of ``base`` for each query by cosine, the query's own row included.

    The queries go over the base in blocks as in ``search``; each task keeps one row a query and label.
    """
    mean = np.array(corpus_mean(base, vector).first().mean or [], float) if centre else None
    out, rows = None, []

    def over(part: list) -> DataFrame:
        ids, vs = np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part], float)
        return base.select(F.col(id_col).cast("long"), vector, F.col(by).cast("int")).mapInArrow(_block_pool(vs, ids, mean), "query_id long, label int, score double, vec_id long")

    for r in queries.select(F.col(id_col).cast("long"), vector).toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            out, rows = (over(rows) if out is None else out.unionByName(over(rows))), []
    if rows:
        out = over(rows) if out is None else out.unionByName(over(rows))
    if out is None:
        out = queries.sparkSession.createDataFrame([], "query_id long, label int, score double, vec_id long")
    best = F.max(F.struct("score", "vec_id")).alias("b")
    return out.groupBy("query_id", "label").agg(best).select("query_id", F.col("label").alias(by), "b.*")


def select_top(scores: DataFrame, k: int, collection: str, hash_col: str, score: str = "score") -> DataFrame:
    """The k best pooled rows over all collections, one a (collection, hash); rows without a hash can't be resolved and go."""
    top = scores.orderBy(F.col(score).desc(), collection, hash_col).limit(k)
    return top.filter(F.col(hash_col).isNotNull()).groupBy(collection, hash_col).agg(F.max(score).alias(score))


def components(vectors: DataFrame, k: int, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, scales): the leading k directions of spread, and the spread along each.

    The scatter matrix is summed in the tasks (dim x dim numbers each), so only it reaches the driver; fewer than k come back from a
    corpus with less spread.
    """
    mean = np.array(corpus_mean(vectors, vector).first().mean or [], float)
    if not mean.size or k <= 0:
        return mean, np.zeros((0, mean.size)), np.zeros(0)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((mean.size, mean.size)), 0
        for b in batches:
            x = np.array([v for v in b.column(0).to_pylist() if v is not None and len(v) == mean.size], float).reshape(-1, mean.size) - mean
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(mean.size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array([n if i == 0 else 0 for i in range(mean.size)], pa.int64())], names=["i", "row", "n"])

    parts = vectors.select(vector).mapInArrow(scatter, "i int, row array<double>, n long").select("i", "n", F.posexplode("row").alias("j", "x"))
    cells = parts.groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    m = np.zeros((mean.size, mean.size))
    for c in cells:
        m[c.i, c.j] = c.x
    n = max(c.n for c in cells if c.i == 0) or 1
    values, vecs = np.linalg.eigh((m + m.T) / 2)
    order = [i for i in np.argsort(values)[::-1][:k] if values[i] > max(np.trace(m), 0) * 1e-12]
    comps = vecs[:, order].T
    signs = np.sign(comps[np.arange(len(comps)), np.abs(comps).argmax(1)]) if len(comps) else np.ones(0)
    return mean, comps * signs[:, None], np.sqrt(np.maximum(values[order], 0) / n)


def project_out(v: Column, mean: np.ndarray, comps: np.ndarray, weights: list[float] | None = None) -> Column:
    """The centred vector with each component scaled by its weight: 0 removes it, 1 keeps it."""
    out = centred(v, F.array(*map(F.lit, mean.tolist())))
    for c, w in zip(comps, weights or [0.0] * len(comps)):
        axis = F.array(*map(F.lit, c.tolist()))
        # components are orthogonal, so each is taken off by its share of the centred vector
        share = dot(centred(v, F.array(*map(F.lit, mean.tolist()))), axis) * float(1 - w)
        out = F.zip_with(out, F.transform(axis, _times(share)), lambda a, b: a - b)
    return out


def _times(factor: Column):
    return lambda x: x * factor

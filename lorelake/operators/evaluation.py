"""IR and calibration metrics over many scenes at once."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Credit of grades, weight of recall.
FULL_GRADE, HALF_GRADE, BETA = 3, 2, 2.0


def credit(grade: Column) -> Column:
    return F.when(grade >= FULL_GRADE, 1.0).when(grade >= HALF_GRADE, 0.5).otherwise(0.0)


def f_beta(precision: Column, recall: Column, beta: float = BETA) -> Column:
    b2 = beta * beta
    return F.when((precision > 0) | (recall > 0), (1 + b2) * precision * recall / (b2 * precision + recall)).otherwise(0.0)


def midranks(rows: DataFrame, value: str, by: list[str], out: str = "rank") -> DataFrame:
    """``rows`` with the mean rank of equal values. Counts by value come first, so ranks run over distinct values only."""
    sizes = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(value)
    below = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.withColumn(out, below + (F.col("_n") + 1) / 2).drop("_n"), [*by, value])


def auc(rows: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """([by,] auc, pos, neg): area under the ROC curve by rank sums; null where a class is absent. Works on counts by score."""
    n, p = F.count(F.lit(1)), F.sum(F.col(label).cast("long"))
    sizes = rows.groupBy(*by, score).agg(n.alias("n"), p.alias("p"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("p").alias("pos"), (F.sum("n") - F.sum("p")).alias("neg"), F.sum(F.col("p") * F.col("rank")).alias("s"))
    area = (F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    return sums.select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), area).alias("auc"), "pos", "neg")


def average_precision(rows: DataFrame, by: list[str], tie: str, score: str = "score", label: str = "label") -> DataFrame:
    """([by,] ap, pos): step-sum average precision; equal scores in order of ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    ranked = rows.select(*by, F.row_number().over(w).alias("i"), F.sum(F.col(label).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tp"), F.col(label).cast("long").alias("y"))
    return ranked.groupBy(*by).agg((F.sum(F.when(F.col("y") == 1, F.col("tp") / F.col("i"))) / F.sum("y")).alias("ap"), F.sum("y").alias("pos"))


def ndcg(rows: DataFrame, by: list[str], tie: str, k: int = 10, score: str = "score", gain: str = "grade") -> DataFrame:
    """([by,] ndcg): the first k rows by score against the best k gains; 0 where no row has a gain."""
    discount = lambda w: F.col(gain) / F.log2(F.row_number().over(w) + 1)
    got = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), tie)
    best = Window.partitionBy(*by).orderBy(F.col(gain).desc())
    cut = lambda w, name: F.when(F.row_number().over(w) <= k, discount(w)).otherwise(0.0).alias(name)
    sums = rows.select(*by, cut(got, "dcg"), cut(best, "ideal")).groupBy(*by).agg(F.sum("dcg").alias("dcg"), F.sum("ideal").alias("ideal"))
    return sums.select(*by, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def cutoff_sweep(rows: DataFrame, scene: str, cutoffs: list[float], score: str = "score", grade: str = "grade") -> DataFrame:
    """(cutoff, scenes, delivered, precision, recall, f2): means over the scenes, at each cutoff; unscored rows are kept.

    The cutoffs are a short constant array exploded inside the aggregate's input.
    """
    at = rows.select(scene, F.col(score), credit(F.col(grade)).alias("c"), (F.col(grade) >= FULL_GRADE).cast("long").alias("rel"), F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff"))
    kept = F.coalesce(F.col(score) >= F.col("cutoff"), F.lit(True))
    each = at.groupBy("cutoff", scene).agg(F.sum(kept.cast("long")).alias("n"), F.sum(F.when(kept, F.col("c"))).alias("c"), F.sum(F.when(kept, F.col("rel")).otherwise(0)).alias("hit"), F.sum("rel").alias("rel"))
    p = F.when(F.col("n") > 0, F.col("c") / F.col("n")).otherwise(0.0)
    r = F.when(F.col("rel") > 0, F.col("hit") / F.col("rel"))
    each = each.withColumn("p", p).withColumn("r", r).filter(F.col("r").isNotNull()).withColumn("f", f_beta(F.col("p"), F.col("r")))
    return each.groupBy("cutoff").agg(F.count(F.lit(1)).alias("scenes"), F.avg("n").alias("delivered"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f2"))


def kappa(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", classes: int = 5) -> DataFrame:
    """([by,] qwk, n): quadratic weighted kappa of two raters' grades 0..classes-1; null without expected disagreement."""
    cells = pairs.groupBy(*by, a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    row = cells.groupBy(*by, F.col(a).alias("i")).agg(F.sum("o").alias("ra"))
    col = cells.groupBy(*by, F.col(b).alias("j")).agg(F.sum("o").alias("rb"))
    weight = lambda x, y: F.pow(x - y, F.lit(2)) / (classes - 1) ** 2
    seen = cells.groupBy(*by).agg(F.sum(weight(F.col(a), F.col(b)) * F.col("o")).alias("num"), F.sum("o").alias("n"))
    key = by or ["_"]  # at most classes x classes rows a group
    row, col, seen = (d if by else d.withColumn("_", F.lit(0)) for d in (row, col, seen))
    expected = row.join(col, key).groupBy(*key).agg(F.sum(weight(F.col("i"), F.col("j")) * F.col("ra") * F.col("rb")).alias("den"))
    out = seen.join(expected, key).select(*by, F.when(F.col("den") > 0, 1 - F.col("num") / (F.col("den") / F.col("n"))).alias("qwk"), F.col("n").cast("long").alias("n"))
    return out


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """([by,] rho, n): rank correlation with mean ranks of ties."""
    ranked = midranks(midranks(rows, x, by, "_rx"), y, by, "_ry")
    sums = ranked.groupBy(*by).agg(F.covar_pop("_rx", "_ry").alias("_c"), (F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("_s"), F.count(F.lit(1)).alias("n"))
    return sums.select(*by, F.when(F.col("_s") > 0, F.col("_c") / F.col("_s")).alias("rho"), "n")


def sign_test(deltas: DataFrame, by: list[str], delta: str = "delta", eps: float = 1e-9) -> DataFrame:
    """([by,] plus, minus, ties, mean, p): exact two-sided sign test; ties are dropped."""
    d = F.col(delta)
    s = deltas.groupBy(*by).agg(F.sum((d > eps).cast("int")).alias("plus"), F.sum((d < -eps).cast("int")).alias("minus"), F.sum((F.abs(d) <= eps).cast("int")).alias("ties"), F.avg(d).alias("mean"))
    n, k = F.col("plus") + F.col("minus"), F.greatest("plus", "minus")
    ln_fact = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i))
    term = lambda i: F.exp(ln_fact(n) - ln_fact(i) - ln_fact(n - i) - n * math.log(2))
    tail = F.aggregate(F.sequence(k, n), F.lit(0.0), lambda a, i: a + term(i))
    return s.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def eta_squared(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the share of the variance of a value that lies between groups."""
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    w = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / w
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) / w - mean * mean
    within = F.sum(F.col("n") * F.col("v")) / w
    return g.agg(F.when(between + within > 0, between / (between + within)).otherwise(0.0).alias("eta2"))


def reliability(rows: DataFrame, p: str = "p", label: str = "label", bins: int = 10) -> DataFrame:
    """(bin, n, lo, hi, mean_p, observed): quantile bins that never split equal probabilities. Bins are cut on counts by value."""
    sizes = rows.groupBy(F.col(p).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("y"))
    total = F.sum("n").over(Window.partitionBy())
    upto = F.sum("n").over(Window.partitionBy().orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    at = sizes.withColumn("bin", F.least(F.floor((upto - F.col("n")) * bins / total), F.lit(bins - 1)))
    return at.groupBy("bin").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean_p"), (F.sum("y") / F.sum("n")).alias("observed"))


def calibration_error(binned: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_p") - F.col("observed"))
    return binned.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def calibration_null(binned: list[tuple[int, float, float]], draws: int = 200, seed: int = 1) -> tuple[float, float]:
    """(mean ECE, share at least as high) of a calibrated model, by seeded draws from the bins' mean probabilities (n, mean_p, observed)."""
    n, p, y = (np.array(c, float) for c in zip(*binned))
    ece = lambda obs: (n * np.abs(p - obs)).sum() / n.sum()
    rng = np.random.default_rng(seed)
    nulls = np.array([ece(rng.binomial(n.astype(int), p) / n) for _ in range(draws)])
    return float(nulls.mean()), float((nulls >= ece(y)).mean())


def logistic_fit(rows: DataFrame, features: list[str], label: str = "label", ridge: float = 1e-6, rounds: int = 50) -> dict:
    """Logistic regression by iteratively reweighted least squares; each round is one aggregate of p(p+3)/2 sums.

    Returns beta (intercept first), standard errors, rounds, whether it converged, and the log loss.
    """
    x = [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]]
    p, beta, cov, done = len(x), np.zeros(len(features) + 1), None, False
    y = F.col(label).cast("double")
    for r in range(1, rounds + 1):
        mu = 1 / (1 + F.exp(-reduce(lambda a, b: a + b, [c * float(v) for c, v in zip(x, beta)])))
        w = F.greatest(mu * (1 - mu), F.lit(1e-8))
        sums = rows.agg(*[F.sum(x[i] * (y - mu)).alias(f"g{i}") for i in range(p)], *[F.sum(x[i] * x[j] * w).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)]).first()
        h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)]) + ridge * np.eye(p)
        g = np.array([sums[f"g{i}"] or 0.0 for i in range(p)]) - ridge * beta
        cov = np.linalg.inv(h)
        step = cov @ g
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            done = True
            break
    mu = 1 / (1 + F.exp(-reduce(lambda a, b: a + b, [c * float(v) for c, v in zip(x, beta)])))
    loss = rows.agg((-F.avg(F.log(F.greatest(F.when(y == 1, mu).otherwise(1 - mu), F.lit(1e-12))))).alias("l")).first().l
    return {"beta": beta.tolist(), "se": np.sqrt(np.maximum(np.diag(cov), 0)).tolist(), "rounds": r, "converged": done, "log_loss": loss}


def cumulative_fit(rows: DataFrame, features: list[str], grade: str, cuts: list[int], **kw) -> dict[int, dict | None]:
    """One fit for each boundary of an ordinal grade, P(grade >= cut); None where a class is absent."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col(grade) >= c).cast("long")).alias(f"c{c}") for c in cuts]).first()
    at = lambda c: rows.withColumn("_y", (F.col(grade) >= c).cast("int"))
    return {c: logistic_fit(at(c), features, "_y", **kw) if 0 < (counts[f"c{c}"] or 0) < counts.n else None for c in cuts}


def holm(tests: DataFrame, p: str = "p", by: list[str] = (), tie: list[str] = ()) -> DataFrame:
    """``tests`` with p_holm, the p-values of a family (by) adjusted step-down; a family is a study's arms, so few rows."""
    w = Window.partitionBy(*by).orderBy(p, *tie)
    left = F.count(F.lit(1)).over(Window.partitionBy(*by)) - F.row_number().over(w) + 1
    return tests.withColumn("_step", F.least(F.lit(1.0), left * F.col(p))).withColumn("p_holm", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")

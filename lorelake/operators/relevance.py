"""The relevance model: standardised signals, expected credit, cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def z_scores(rows: DataFrame, features: list[str], by: list[str], population: Column | None = None) -> DataFrame:
    """``rows`` with z_<feature>: population mean and deviation over ``by``; a deviation of 0 counts as 1, a missing value as 0.

    Means come from one aggregate and a join, so a hot group is summed before the shuffle.
    """
    base = rows if population is None else rows.filter(population)
    v = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    stats = base.groupBy(*by).agg(*[F.avg(v(f)).alias(f"_m_{f}") for f in features], *[F.stddev_pop(v(f)).alias(f"_s_{f}") for f in features])
    z = {f"z_{f}": (v(f) - F.coalesce(f"_m_{f}", F.lit(0.0))) / F.when(F.coalesce(f"_s_{f}", F.lit(0.0)) > 1e-12, F.col(f"_s_{f}")).otherwise(1.0) for f in features}
    return rows.join(stats, by, "left").withColumns(z).drop(*[f"_m_{f}" for f in features], *[f"_s_{f}" for f in features])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def expected_credit(z: list[Column], beta2: list[float], beta3: list[float]) -> Column:
    """Half of P(grade >= 2) and half of P(grade >= 3), the latter never above the former."""
    if not len(beta2) == len(beta3) == len(z) + 1:
        raise ValueError(f"{len(z)} features need {len(z) + 1} coefficients a boundary, not {len(beta2)} and {len(beta3)}")
    eta = lambda b: reduce(lambda a, x: a + x, [F.lit(float(b[0])), *[c * float(w) for c, w in zip(z, b[1:])]])
    p2 = sigmoid(eta(beta2))
    return 0.5 * p2 + 0.5 * F.least(sigmoid(eta(beta3)), p2)


def score(rows: DataFrame, features: list[str], beta2: list[float], beta3: list[float], by: list[str], population: Column | None = None) -> DataFrame:
    """``rows`` with e_credit. Where a group's ``text`` is flat and its ``keys`` isn't, keys stand in for text."""
    if "text" in features and "keys" in rows.columns:
        base = rows if population is None else rows.filter(population)
        spread = lambda f: F.coalesce(F.stddev_pop(F.coalesce(F.col(f).cast("double"), F.lit(0.0))), F.lit(0.0))
        flat = base.groupBy(*by).agg(((spread("text") <= 1e-12) & (spread("keys") > 1e-12)).alias("_swap"))
        rows = rows.join(flat, by, "left").withColumn("_text", F.when(F.col("_swap"), F.col("keys")).otherwise(F.col("text"))).drop("_swap")
        features = ["_text" if f == "text" else f for f in features]
    scored = z_scores(rows, features, by, population)
    return scored.withColumn("e_credit", expected_credit([F.col(f"z_{f}") for f in features], beta2, beta3)).drop(*[f"z_{f}" for f in features], "_text")


def weighted_credit(e: Column, log_weight: Column) -> Column:
    """Expected credit with its odds multiplied by the author's weights."""
    inside = (e > 0) & (e < 1) & (F.coalesce(log_weight, F.lit(0.0)) != 0)
    return F.when(inside, sigmoid(F.log(e / (1 - e)) + log_weight)).otherwise(e)


def cut(rows: DataFrame, cutoff: Column | float | None, score_col: str = "e_credit") -> DataFrame:
    """Rows at or above the cutoff; unscored rows stay, and without a cutoff all do."""
    c = F.lit(cutoff) if not isinstance(cutoff, Column) else cutoff
    return rows.filter(F.col(score_col).isNull() | F.isnan(score_col) | c.isNull() | (F.col(score_col) >= c))


def available(entries: DataFrame, at: str) -> DataFrame:
    """Entries that don't postdate message ``at``: by their end, else their start; without either they are available."""
    later = F.coalesce(F.col("end_at") >= F.col(at), F.col("start_at") > F.col(at), F.lit(False))
    return entries.filter(~F.coalesce(later, F.lit(False)))


def shared_names(entry_names: DataFrame, window_names: DataFrame, name_df: DataFrame) -> DataFrame:
    """(chat_id, entry_id, proper_nouns): idf mass of the names an entry shares with a chat's window.

    entry_names (world, entry_id, term), window_names (chat_id, world, term), name_df (world, term, df, ndoc).
    """
    pairs = window_names.join(entry_names, ["world", "term"]).join(name_df, ["world", "term"])
    return pairs.groupBy("chat_id", "entry_id").agg(F.sum(F.log((F.col("ndoc") + 1) / (F.col("df") + 1))).alias("proper_nouns"))


def leave_one_out_mean(rows: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """``rows`` with the group's mean without the row itself; null in a group of one."""
    sums = rows.groupBy(*by).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return rows.join(sums, by).withColumn(out, F.when(F.col("_n") > 1, (F.col("_s") - F.col(value)) / (F.col("_n") - 1))).drop("_s", "_n")


def rank_gaps(rows: DataFrame, by: list[str], tie: str, score_col: str = "score", top: int = 5) -> DataFrame:
    """The first ``top`` rows with rank and the gap to the score before."""
    w = Window.partitionBy(*by).orderBy(F.col(score_col).desc_nulls_last(), tie)
    ranked = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.withColumn("gap", F.lag(score_col).over(w) - F.col(score_col))

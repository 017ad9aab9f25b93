"""Graded rows: verdicts, the grade in force, unions of arms, merges, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdicts(items: DataFrame, raters: DataFrame) -> DataFrame:
    """(item_id, pos, kind, rater_id, grade, graded_at) of every verdict, in the order written; valid marks grades 0..4."""
    v = items.select("item_id", "capture_id", F.posexplode("grades").alias("pos", "g"))
    v = v.select("item_id", "capture_id", "pos", F.col("g.rater").alias("rater"), F.col("g.grade").alias("grade"), F.col("g.graded_at").alias("graded_at"))
    who = raters.groupBy("capture_id", "rater").agg(F.min("rater_id").alias("rater_id"), F.min(F.lower("kind")).alias("kind"))
    return v.join(who, ["capture_id", "rater"], "left").withColumn("valid", F.coalesce(F.col("grade").between(0, 4), F.lit(False)))


def in_force(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, grade, rule): the latest human verdict, else the lower median of three or more model verdicts, else the latest of those."""
    valid = rows.filter("valid AND kind IN ('human', 'llm')")
    human = F.max_by("grade", F.when(F.col("kind") == "human", F.col("pos")))
    llm = lambda c: F.when(F.col("kind") == "llm", F.col(c))
    agg = valid.groupBy(*by).agg(human.alias("human"), F.count(llm("grade")).alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN kind = 'llm' THEN grade END)").alias("median"), F.max_by("grade", llm("pos")).alias("latest"))
    human_ok = F.col("human").isNotNull()
    grade = F.when(human_ok, F.col("human")).when(F.col("n") >= 3, F.col("median").cast("int")).otherwise(F.col("latest"))
    rule = F.when(human_ok, "human").when(F.col("n") >= 3, "median").otherwise("latest")
    return agg.select(*by, grade.cast("int").alias("grade"), rule.alias("rule"))


def union_arms(rows: DataFrame, signals: list[str], by: list[str], arm: str = "arm", rank: str = "rank") -> DataFrame:
    """One row a key over all arms: the arms in order, the best rank, and each signal from the first arm that has it."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(arm), F.col(rank))))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(arm)).alias("arms"), F.min(rank).alias("best_rank"), *[first(c).alias(c) for c in signals])


def split_graded(rows: DataFrame, grades: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without a grade, rows with one)."""
    return rows.join(grades.select(*by).distinct(), by, "left_anti"), rows.join(grades.select(*by).distinct(), by, "left_semi")


def merge_passes(prior: DataFrame, fresh: DataFrame, by: list[str], day: Column) -> DataFrame:
    """All verdicts; a second one of the same rater on the same day and row is the same pass, and the prior one stays."""
    both = prior.withColumn("_old", F.lit(0)).unionByName(fresh.withColumn("_old", F.lit(1)), allowMissingColumns=True)
    key = [*by, "rater_id", "_day"]
    kept = both.withColumn("_day", day).groupBy(*key).agg(F.min_by(F.struct(*[c for c in both.columns if c not in (*by, "rater_id", "_old")]), F.struct("_old", "graded_at")).alias("v"))
    return kept.select(*by, "rater_id", "v.*")


def searched_book(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, book): the book with the most rows that were scored by similarity; equal counts by name."""
    n = rows.filter(F.col("cosine").isNotNull() & (F.coalesce("book", F.lit("")) != "")).groupBy(*by, "book").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.min_by("book", F.struct((-F.col("n")).alias("n"), "book")).alias("book"))


def graft(grades: DataFrame, old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """``grades`` with fate: kept where title and content of the entry are as they were, else the first reason that holds."""
    o = old.select(*by, F.col("comment").alias("_t0"), F.col("content").alias("_c0"), F.lit(True).alias("_o"))
    n = new.select(*by, F.col("comment").alias("_t1"), F.col("content").alias("_c1"), F.lit(True).alias("_n"))
    j = grades.join(o, by, "left").join(n, by, "left")
    fate = F.when(F.col("_o").isNull(), "unknown entry").when(F.col("_n").isNull(), "entry gone").when(~F.col("_t0").eqNullSafe(F.col("_t1")), "title changed").when(~F.col("_c0").eqNullSafe(F.col("_c1")), "content changed").otherwise("kept")
    return j.withColumn("fate", fate).drop("_t0", "_c0", "_t1", "_c1", "_o", "_n")


def rater_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """(item, rater_a, rater_b, a, b): two annotators' latest grades on an item, each pair once; an item holds few annotators."""
    last = rows.filter("valid AND rater_id IS NOT NULL").groupBy(*by, "rater_id").agg(F.max_by("grade", F.struct("graded_at", "pos")).alias("grade"))
    x, y = last.select(*by, F.col("rater_id").alias("rater_a"), F.col("grade").alias("a")), last.select(*by, F.col("rater_id").alias("rater_b"), F.col("grade").alias("b"))
    return x.join(y, by).filter("rater_a < rater_b")


def jobs(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """``rows`` with job, runs of ``size`` rows in order. Numbers come from a range partition and its counts, not from one task."""
    from .scenes import numbered

    return numbered(rows.withColumn("_all", F.lit(0)), "_all", list(order)).withColumn("job", F.floor(F.col("back") / size)).drop("back", "_all")


def difference(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, side): rows that only one of two delivered sets holds."""
    x, y = a.select(*by, F.lit(True).alias("_a")).distinct(), b.select(*by, F.lit(True).alias("_b")).distinct()
    side = F.when(F.col("_b").isNull(), "first").when(F.col("_a").isNull(), "second").otherwise("both")
    return x.join(y, by, "full_outer").select(*by, side.alias("side"))

"""Offline studies over graded rows: what one evaluation tool computes each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import f_beta, holm, kappa, ndcg, sign_test
from .scenes import ORDER, sliding, spoken, usable_messages


def pool_extension(runs: DataFrame, judged: DataFrame, k: int, by: list[str]) -> DataFrame:
    """(by, arms, best_rank): rows in some arm's first k that nobody has judged."""
    top = runs.filter(F.col("rank") < k).join(judged.select(*by).distinct(), by, "left_anti")
    return top.groupBy(*by).agg(F.array_sort(F.collect_set("arm")).alias("arms"), F.min("rank").alias("best_rank"))


def divergences(rows: DataFrame, fired: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind): delivered rows graded 1 or less (over-match), and rows not delivered though a key hit the window (miss)."""
    over = rows.filter(F.col("delivered") & (F.col("grade") <= 1)).select(*by, F.lit("over-match").alias("kind"))
    miss = fired.select(*by).distinct().join(rows.filter("delivered").select(*by), by, "left_anti").select(*by, F.lit("miss").alias("kind"))
    return over.unionByName(miss)


def judge_agreement(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """([by,] n, exact, within_one, precision, recall, f1, qwk) of judge b against a; the last ones for grades of 3 and more."""
    hi = lambda c: F.col(c) >= 3
    tp, pp, rp = F.sum((hi(a) & hi(b)).cast("int")), F.sum(hi(b).cast("int")), F.sum(hi(a).cast("int"))
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("exact"), F.avg((F.abs(F.col(a) - F.col(b)) <= 1).cast("double")).alias("within_one"), F.when(pp > 0, tp / pp).alias("precision"), F.when(rp > 0, tp / rp).alias("recall"))
    f1 = f_beta(F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0)), 1.0)
    return out.withColumn("f1", f1).join(kappa(pairs, by, a, b).drop("n"), by)


def confusion(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """One row a grade of judge a, one column a grade of judge b."""
    return pairs.groupBy(*by, a).pivot(b, [0, 1, 2, 3, 4]).count().fillna(0)


def delivered_f2(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, f2): of the rows with ``delivered`` against their grades."""
    c = F.when(F.col("grade") >= 3, 1.0).when(F.col("grade") >= 2, 0.5).otherwise(0.0)
    on, rel = F.col("delivered").cast("int"), (F.col("grade") >= 3).cast("int")
    s = rows.groupBy(*by).agg(F.sum(on).alias("n"), F.sum(c * on).alias("c"), F.sum(rel * on).alias("hit"), F.sum(rel).alias("rel"))
    p, r = F.when(F.col("n") > 0, F.col("c") / F.col("n")).otherwise(0.0), F.when(F.col("rel") > 0, F.col("hit") / F.col("rel")).otherwise(0.0)
    return s.select(*by, f_beta(p, r).alias("f2"))


def paired(runs: DataFrame, scene: str, arm: str, base: str, value: str = "f2") -> DataFrame:
    """(arm, plus, minus, ties, mean, p): each arm against the base over the same scenes; an arm over other scenes is refused."""
    b = runs.filter(F.col(arm) == base).select(scene, F.col(value).alias("_b"))
    rest = runs.filter(F.col(arm) != base)
    sizes = rest.join(b, scene, "full_outer").groupBy().agg(F.sum((F.col("_b").isNull() | F.col(value).isNull()).cast("int")).alias("odd")).first()
    if sizes.odd:
        raise ValueError(f"{sizes.odd} scenes are in one run only")
    return sign_test(rest.join(b, scene).withColumn("delta", F.col(value) - F.col("_b")), [arm])


def rate_bands(keys: DataFrame, hits: Column) -> DataFrame:
    """(band, rows, keys): suggestions by how many messages they match, by row and by distinct key."""
    band = F.when(hits == 0, "0").when(hits <= 3, "1-3").when(hits <= 20, "4-20").when(hits <= 100, "21-100").otherwise(">100")
    return keys.withColumn("band", band).groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("key").alias("keys"))


def token_offsets(rows: DataFrame, recorded: str, counted: str, by: list[str]) -> DataFrame:
    """(by, n, low, high, constant) of recorded minus counted tokens."""
    d = F.col(recorded) - F.col(counted)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("low"), F.max(d).alias("high")).withColumn("constant", F.col("low") == F.col("high"))


def route_union(keyword: DataFrame, similar: DataFrame, k: int, tokens: int, scene: str = "scene") -> DataFrame:
    """The simple baseline: keyword rows and the k most similar, by authored order until the budget is full."""
    w = Window.partitionBy(scene).orderBy(F.col("score").desc(), "entry_id")
    near = similar.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select(scene, "entry_id", "authored", "tokens")
    rows = keyword.select(scene, "entry_id", "authored", "tokens").unionByName(near).dropDuplicates([scene, "entry_id"])
    upto = F.sum("tokens").over(Window.partitionBy(scene).orderBy("authored", "entry_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).filter(F.col("upto") <= tokens)


def tier_recall(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, relevant, found, recall) by tier and in all, by rollup."""
    rel, on = (F.col("grade") >= 3).cast("int"), F.col("delivered").cast("int")
    s = rows.rollup(*by).agg(F.sum(rel).alias("relevant"), F.sum(rel * on).alias("found"))
    return s.withColumn("recall", F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant")))


def synthetic_scenes(messages: DataFrame, depth: int, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """(chat_id, msg_id, scan): for sampled messages, the texts of the last ``depth`` usable ones up to it; fraction 1 takes every message."""
    rows = usable_messages(messages).select("chat_id", "msg_id", "t", spoken().alias("text"))
    said = sliding(rows, "chat_id", list(ORDER), depth, "text", "said")
    out = said.select("chat_id", "msg_id", F.array_join("said", "\n").alias("scan"))
    return out if fraction >= 1 else out.filter(F.pmod(F.xxhash64("msg_id", F.lit(seed)), F.lit(10_000)) < int(fraction * 10_000))


def recursion_report(found: DataFrame) -> DataFrame:
    """(depth, entries): how far activations reach."""
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("entries"))


def ungated(with_gate: DataFrame, without: DataFrame, hits: DataFrame) -> DataFrame:
    """(band, rows, keys): keys that a gate keeps out, by how often chats use them."""
    lost = without.select("key").distinct().join(with_gate.select("key").distinct(), "key", "left_anti").join(hits, "key", "left")
    return rate_bands(lost, F.coalesce("messages_with", F.lit(0)))


def repaired_tiers(entries: DataFrame, memory_title: str) -> DataFrame:
    """``entries`` with the tier that their title's form says."""
    return entries.withColumn("tier", F.when(F.coalesce(F.col("comment").rlike(memory_title), F.lit(False)), "memory").otherwise("reference"))


def parameter_grid(rows: DataFrame, arms: dict[str, Column], scene: str, tie: str, k: int = 10) -> DataFrame:
    """(arm, scenes, ndcg): each arm's score column re-ranks every scene; all arms are rows of one plan, so the grid is read once."""
    each = rows.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), c.alias("arm_score")) for a, c in arms.items()])).alias("x")).select("*", "x.*")
    out = ndcg(each, ["arm", scene], tie, k, score="arm_score")
    return out.groupBy("arm").agg(F.count(F.lit(1)).alias("scenes"), F.avg("ndcg").alias("ndcg"))


def parameter_screen(rows: DataFrame, arms: dict[str, Column], base: str, scene: str) -> DataFrame:
    """(arm, plus, minus, ties, mean, p, p_holm): F2 of each arm's delivery (a condition) against the base's, scene by scene, p-values adjusted over the arms."""
    each = rows.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), c.alias("delivered")) for a, c in arms.items()])).alias("x")).select(*[c for c in rows.columns if c not in ("arm", "delivered")], "x.*")
    runs = delivered_f2(each, [scene, "arm"])
    return holm(paired(runs, scene, "arm", base), tie=["arm"])

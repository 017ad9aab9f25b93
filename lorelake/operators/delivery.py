"""Layout, order and budget: what fits into a prompt, in what order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relevance import weighted_credit

BLOCKS = ("constant", "sticky", "promoted", "dynamic")


def _num(c: str, default: float = 0) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(float(default)))


def _by(primary: list[Column]) -> list[Column]:
    return [*primary, _num("order").desc(), F.col("uid").asc()]


def _title(desc: bool) -> Column:
    c = F.collate(F.trim(F.coalesce("comment", F.lit(""))), "UNICODE")
    return c.desc() if desc else c.asc()


SORTS: dict[str, Callable[[], list[Column]]] = {
    "priority": lambda: _by([F.when(F.coalesce("disable", F.lit(False)), 2).when(F.coalesce("constant", F.lit(False)), 0).otherwise(1).asc()]),
    "custom": lambda: _by([_num("display_index").asc()]),
    "title-asc": lambda: _by([_title(False)]),
    "title-desc": lambda: _by([_title(True)]),
    "tokens-asc": lambda: _by([F.length(F.coalesce("content", F.lit(""))).asc()]),
    "tokens-desc": lambda: _by([F.length(F.coalesce("content", F.lit(""))).desc()]),
    "depth-asc": lambda: _by([_num("depth").asc()]),
    "depth-desc": lambda: _by([_num("depth").desc()]),
    "order-asc": lambda: _by([_num("order").asc()]),
    "order-desc": lambda: _by([_num("order").desc()]),
    "uid-asc": lambda: _by([F.col("uid").asc()]),
    "uid-desc": lambda: _by([F.col("uid").desc()]),
    "prob-asc": lambda: _by([_num("probability", 100).asc()]),
    "prob-desc": lambda: _by([_num("probability", 100).desc()]),
}
#: older names of two orders
ALIASES = {"authored": "order-asc", "authored-inverse": "order-desc"}

TIERS = {
    "constant": lambda: ~F.coalesce("disable", F.lit(False)) & F.coalesce("constant", F.lit(False)),
    "sticky": lambda: ~F.coalesce("disable", F.lit(False)) & (_num("sticky") > 0),
    "keyword": lambda: ~F.coalesce("disable", F.lit(False)) & ~F.coalesce("vectorized", F.lit(False)),
    "vector": lambda: ~F.coalesce("disable", F.lit(False)) & F.coalesce("vectorized", F.lit(False)),
    "disabled": lambda: F.coalesce("disable", F.lit(False)),
}


def entry_order(name: str, tiers: list[str] | None = None) -> list[Column]:
    """Sort columns of a named order; with ``tiers``, the first tier that holds leads."""
    cols = SORTS[ALIASES.get(name, name)]()
    if tiers is None:
        return cols
    names = [*tiers, *[t for t in TIERS if t not in tiers]]
    rank = F.lit(len(names))
    for i, t in reversed(list(enumerate(names))):
        rank = F.when(TIERS[t](), i).otherwise(rank)
    return [rank.asc(), *cols]


def with_missing(entries: DataFrame) -> DataFrame:
    """The columns that the orders read, null where a table lacks them."""
    lacking = {c: F.lit(None).cast("double") for c in ("order", "display_index", "depth", "probability", "sticky") if c not in entries.columns}
    return entries.withColumns(lacking) if lacking else entries


def layout(items: DataFrame, mode: str = "interleaved", by: str = "scene") -> DataFrame:
    """``items`` with walk, the place in the budget's walk of its scene (0 first).

    Columns read: block, e_credit, log_weight, authored (order), and of the book: tier, weight, offset. Durable blocks go by authored order,
    promoted and dynamic ones by score: in ``sequential`` mode the book's tier leads, in ``interleaved`` the book's weight scales.
    """
    score = F.coalesce(F.when(~F.isnan("e_credit"), weighted_credit(F.col("e_credit"), F.col("log_weight"))), F.lit(-1.0))
    ranked = F.col("block").isin("promoted", "dynamic")
    block = F.array_position(F.array(*map(F.lit, BLOCKS)), F.col("block"))
    authored = F.col("authored") + (F.lit(0) if mode == "sequential" else F.coalesce("offset", F.lit(0)))
    lead = [F.when(ranked, F.col("tier"))] if mode == "sequential" else []
    scaled = score if mode == "sequential" else score * F.coalesce("weight", F.lit(1.0))
    w = Window.partitionBy(by).orderBy(block, *[c.asc_nulls_last() for c in lead], F.when(ranked, scaled).desc(), authored.asc(), F.col("entry_id").asc())
    return items.withColumn("walk", F.row_number().over(w) - 1)


@dataclass(frozen=True)
class Caps:
    tokens: int = 0
    total: int = 0
    dynamic: int = 0
    vector: int = 0
    slack: float = 0.0
    slack_once: bool = True
    exempt_is_budgeted: bool = False


class _Walk:
    """The running state of one scene's budget; rows come in walk order and are judged once."""

    def __init__(self, caps: Caps):
        self.caps, self.spent, self.prompt, self.counted, self.dynamic, self.vector, self.slack_used = caps, 0, 0, 0, 0, 0, False
        self.books: dict[str, int] = {}

    def judge(self, tokens: int, block: str, vector: bool, exempt: bool, book: str, book_cap: int) -> tuple[bool, list[str], int]:
        c = self.caps
        after = self.spent + tokens
        over = c.tokens > 0 and after > c.tokens
        rescued = over and c.slack > 0 and after <= c.tokens * (1 + c.slack) and not (c.slack_once and self.slack_used)
        capped = block in ("promoted", "dynamic")
        reasons = [
            name
            for name, hit in (
                ("tokens", over and not rescued),
                ("total", 0 < c.total <= self.counted),
                ("dynamic", block == "dynamic" and 0 < c.dynamic <= self.dynamic),
                ("vector", capped and vector and 0 < c.vector <= self.vector),
                ("book", capped and 0 < book_cap <= self.books.get(book, 0)),
            )
            if hit
        ]
        short = max(0, after - c.tokens) if over else 0
        if reasons and not exempt:
            return False, reasons, short
        if not exempt or c.exempt_is_budgeted:
            self.slack_used |= rescued
            self.spent = after
        self.prompt += tokens
        if not exempt:
            self.counted += 1
            self.dynamic += block == "dynamic"
            if capped:
                self.vector += vector
                self.books[book] = self.books.get(book, 0) + 1
        return True, [], short


def _walker(caps: Caps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene, state = None, _Walk(caps)
        names = ["scene", "entry_id", "walk", "admitted", "reasons", "shortfall", "spent", "in_prompt"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            rows = []
            for s, e, walk, tokens, block, vector, exempt, book, cap in zip(*(b.column(c).to_pylist() for c in ("scene", "entry_id", "walk", "tokens", "block", "vector", "exempt", "book", "book_cap"))):
                if s != scene:
                    scene, state = s, _Walk(caps)
                ok, reasons, short = state.judge(int(tokens or 0), block, bool(vector), bool(exempt), book, int(cap or 0))
                rows.append((s, e, walk, ok, reasons, short, state.spent, state.prompt))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def budget(rows: DataFrame, caps: Caps) -> DataFrame:
    """(scene, entry_id, walk, admitted, reasons, shortfall, spent, in_prompt, tail) of rows (scene, entry_id, walk, tokens, block, vector, exempt, book, book_cap).

    A row that doesn't fit is skipped and the walk goes on. The walk is a fold in order, so a scene is one stream of sorted
    rows through one task; it is never held in memory. tail marks rows after the last one admitted.
    """
    cols = ["scene", "entry_id", "walk", "tokens", "block", "vector", "exempt", "book", "book_cap"]
    ordered = rows.select(F.col("scene").cast("string").alias("scene"), *cols[1:]).repartition("scene").sortWithinPartitions("scene", "walk")
    out = ordered.mapInArrow(_walker(caps), "scene string, entry_id long, walk int, admitted boolean, reasons array<string>, shortfall long, spent long, in_prompt long")
    last = F.max(F.when(F.col("admitted"), F.col("walk")).otherwise(-1)).over(Window.partitionBy("scene"))
    return out.withColumn("tail", ~F.col("admitted") & (F.col("walk") > last))


def stop_budget(rows: DataFrame, tokens: int, by: str = "scene", order: str = "walk") -> DataFrame:
    """The other budget: it stops at the first row that overflows, so a running sum says it all."""
    w = Window.partitionBy(by).orderBy(order)
    upto = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    over = F.max((F.col("upto") > tokens).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).withColumn("over", over).filter("over = 0").drop("over")


def undecided_dropped(rows: DataFrame) -> DataFrame:
    """What ships when ranking failed: constants and armed stickies."""
    return rows.filter(F.col("block").isin("constant", "sticky"))


def prompt_order(rows: DataFrame, order: list[Column], by: str = "scene", first: int = 99_000) -> DataFrame:
    """``rows`` with prompt_order, numbers from ``first`` on in the order of presentation."""
    return rows.withColumn("prompt_order", F.row_number().over(Window.partitionBy(by).orderBy(*order)) + (first - 1))


# Fixed value: the places of the blocks in a grading table.
GRADE_BLOCKS = {"dynamic": 0, "promoted": 0, "sticky": 1, "constant": 2}


def grade_order(rows: DataFrame, rank: str, by: str = "scene", tie: str = "entry_id") -> DataFrame:
    """``rows`` with place: what was ranked first, then stickies, then constants, by ``rank`` within."""
    block = F.coalesce(*[F.when(F.col("block") == b, n) for b, n in GRADE_BLOCKS.items()], F.lit(0))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(block, rank, tie)) - 1)


def host_order(rows: DataFrame, by: str = "scene") -> DataFrame:
    """``rows`` (sticky boolean, source, order, external) with place in the host's own batch: stickies first, then the source class, then higher orders; externals count as order -1."""
    order = F.when(F.coalesce("external", F.lit(False)), -1).otherwise(F.coalesce("order", F.lit(0)))
    w = Window.partitionBy(by).orderBy(F.coalesce("sticky", F.lit(False)).desc(), "source", order.desc(), "entry_id")
    return rows.withColumn("place", F.row_number().over(w) - 1)

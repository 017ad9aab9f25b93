"""Facets, search and other predicates over entries."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import smartkeys as S

_on = lambda c: F.coalesce(F.col(c), F.lit(False))


def facets() -> list[dict[str, Column]]:
    """Groups of facets; ticked ones are alternatives within a group and conditions across groups."""
    constant, vector = _on("constant"), _on("vectorized")
    return [
        {"constant": constant, "vector": ~constant & vector, "keyword": ~constant & ~vector},
        {"enabled": ~_on("disable"), "disabled": _on("disable")},
        {"gated": F.coalesce(F.size("keysecondary"), F.lit(0)) > 0, "grouped": F.col("entry_group").isNotNull()},
    ]


def faceted(entries: DataFrame, ticked: set[str]) -> DataFrame:
    groups = [[c for name, c in g.items() if name in ticked] for g in facets()]
    wanted = [reduce(or_, g) for g in groups if g]
    return entries.filter(reduce(and_, wanted)) if wanted else entries


def search(entries: DataFrame, query: str, fields: tuple[str, ...] = ("comment", "key", "content")) -> DataFrame:
    """``entries`` whose title, keys or text satisfies the query as a whole, with found_in: 0 title, 1 keys, 2 text, the first that does.

    The query is read as an expression and compiled to columns, so the search runs inside generated code.
    """
    tree = S.build(query if query.lstrip().startswith("?") else f"? {query}")

    def holds(c: Column) -> Column:
        return S.compile_match(tree, T.fold(c), T.ortho(c), c)

    tests = {"comment": holds(F.coalesce("comment", F.lit(""))), "key": holds(F.array_join(F.coalesce("key", F.array()), "\n")), "content": holds(T.masked(F.coalesce("content", F.lit(""))))}
    place = F.lit(None).cast("int")
    for i, f in reversed(list(enumerate(("comment", "key", "content")))):
        if f in fields:
            place = F.when(tests[f], i).otherwise(place)
    return entries.withColumn("found_in", place).filter(F.col("found_in").isNotNull())


def state_parts(entries: DataFrame | None = None) -> Column:
    """What an entry is, as a list for display."""
    return F.array_compact(F.array(F.when(_on("disable"), "disabled"), F.when(_on("constant"), "constant"), F.when(_on("vectorized"), "vector"), F.when(F.coalesce(F.size("keysecondary"), F.lit(0)) > 0, "gated")))


def ranked_search(entries: DataFrame, query: str, fields: tuple[str, ...] = ("comment", "key", "content"), by: str = "world") -> DataFrame:
    """``search`` with place: finds in titles before those in keys before those in texts, else in the order of uid."""
    return search(entries, query, fields).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("found_in", "uid", "entry_id")))


def packed_by_length(values: Column) -> Column:
    """An array of strings, the longest first; equal lengths stay in order."""
    return F.transform(F.array_sort(F.transform(values, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))), lambda x: x["v"])

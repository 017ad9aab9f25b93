"""Catalogue questions: components, lineages of books, orphan bindings, nearest names, attached books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import code_units, fnv1a, hex32
from ..session import stored


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of edges (u, v) of longs: the smallest node reachable.

    Each round a node takes the smallest label among its neighbours and the label of that label (pointer jumping), so paths
    shrink by more than half a round; rounds end when no label moves.
    """
    both = stored(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")).withColumnRenamed("u", "node"), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = labels.select("node", "c").join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        jump = step.join(labels.select(F.col("node").alias("c"), F.col("c").alias("cc")), "c", "left").select("node", F.coalesce(F.least("c", "cc"), "c").alias("c"), "old")
        now = stored(jump, "labels", instead=labels)
        moved = now.filter("c <> old").limit(1).count()
        labels = now
        if not moved:
            return now.select("node", F.col("c").alias("component"))
    raise RuntimeError("the components did not settle")


def lineages(entries: DataFrame, threshold: float = 0.3, recency: DataFrame | None = None) -> DataFrame:
    """(world, lineage): books that share entry bodies by the overlap coefficient, each group named after its most recently used
    book (recency: world, stamp), then its shortest, then its first name."""
    body = F.lower(F.trim(F.regexp_replace("content", r"\s+", " ")))
    sigs = entries.filter(F.coalesce("content", F.lit("")) != "").select("world", F.md5(body).alias("h")).distinct()
    sizes = sigs.groupBy("world").agg(F.count(F.lit(1)).alias("n"))
    # a book that shares enough with one at least as large shares one of its rarest bodies, so bodies that many books hold open no pairs
    held = sigs.groupBy("h").agg(F.count(F.lit(1)).alias("k")).join(sigs, "h").join(sizes, "world")
    place = F.row_number().over(Window.partitionBy("world").orderBy("k", "h"))
    asked = held.withColumn("place", place).filter((F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & (F.col("k") > 1))
    a, b = asked.select(F.col("world").alias("a"), "h", F.col("n").alias("na")), held.filter("k > 1").select(F.col("world").alias("b"), "h", F.col("n").alias("nb"))
    larger = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    near = a.join(b, "h").filter(larger).select("a", "b").distinct()
    mine, theirs = sigs.select(F.col("world").alias("a"), "h"), sigs.select(F.col("world").alias("b"), "h")
    shared = near.join(mine, "a").join(theirs, ["b", "h"]).groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.count(F.lit(1)).alias("shared"))
    a, b = sizes.select(F.col("world").alias("x"), F.col("n").alias("nx")), sizes.select(F.col("world").alias("y"), F.col("n").alias("ny"))
    linked = shared.join(a, "x").join(b, "y").filter(F.col("shared") / F.least("nx", "ny") >= threshold)
    ids = entries.select("world").distinct().select("world", F.xxhash64("world").alias("id"))
    edges = linked.select(F.xxhash64("x").alias("u"), F.xxhash64("y").alias("v"))
    comp = ids.join(components(edges).withColumnRenamed("node", "id"), "id", "left").select("world", F.coalesce("component", "id").alias("c"))
    stamped = comp.join(recency, "world", "left") if recency is not None else comp.withColumn("stamp", F.lit(None).cast("timestamp"))
    w = Window.partitionBy("c").orderBy(F.col("stamp").desc_nulls_last(), F.length("world"), "world")
    return stamped.select("world", F.first("world").over(w).alias("lineage"))


def orphan_bindings(chats: DataFrame, books: DataFrame) -> DataFrame:
    """(name, chats): bound books that don't exist, most chats first."""
    lost = chats.filter(F.coalesce("world_info", F.lit("")) != "").join(books.select(F.col("world").alias("world_info")), "world_info", "left_anti")
    return lost.groupBy(F.col("world_info").alias("name")).agg(F.count(F.lit(1)).alias("chats")).orderBy(F.col("chats").desc(), "name")


def nearest_name(missing: DataFrame, names: DataFrame, limit: int = 20_000) -> DataFrame:
    """(name, nearest): the existing name a missing one most likely meant: the longest shared prefix where one contains the other,
    else the smallest edit distance up to 2 or a fifth of its length; null if there is none.

    Prefix matches are an equality join on the shorter name. Edit distances are taken between names whose lengths allow it, block by block of length and
    against a list of existing names that is checked to be small; a longer list is joined on length.
    """
    norm = T.normal_name
    m = missing.select("name", norm("name").alias("m")).distinct().filter("m <> ''")
    w = names.select(F.col("name").alias("w"), norm("name").alias("n")).distinct().filter("n <> ''")
    upto = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.col(c), F.lit(1), i))
    inside = m.select("name", "m", F.explode(upto("m")).alias("n")).join(w, "n").select("name", "w", F.length("n").alias("shared"))
    around = w.select("w", "n", F.explode(upto("n")).alias("m")).join(m, "m").select("name", "w", F.length("m").alias("shared"))
    prefix = inside.unionByName(around).filter("name <> w").groupBy("name").agg(F.min(F.struct((-F.col("shared")).alias("s"), "w")).w.alias("by_prefix"))
    reach = F.greatest(F.lit(2), F.floor(F.length("m") * 0.2)).cast("int")
    lens = m.withColumn("reach", reach).withColumn("len", F.explode(F.sequence(F.greatest(F.length("m") - reach, F.lit(1)), F.length("m") + reach)))
    right = w.withColumn("len", F.length("n"))
    right = F.broadcast(right) if right.limit(limit + 1).count() <= limit else right
    near = lens.join(right, "len").filter("name <> w").withColumn("d", F.levenshtein("m", "n")).filter(F.col("d") <= F.col("reach"))
    edit = near.groupBy("name").agg(F.min(F.struct("d", "w")).w.alias("by_edit"))
    return m.select("name").join(prefix, "name", "left").join(edit, "name", "left").select("name", F.coalesce("by_prefix", "by_edit").alias("nearest"))


def book_chats(chats: DataFrame, book: Column | str, card_book: str | None = None, extra_books: str | None = None, global_books: list[str] = ()) -> DataFrame:
    """``chats`` with why: how each is bound to a book, the closest binding first; null if it isn't."""
    b = F.lit(book) if isinstance(book, str) else book
    why = F.when(F.col("world_info") == b, "chat-bound")
    if card_book:
        why = why.when(F.col(card_book) == b, "character-bound")
    if extra_books:
        why = why.when(F.array_contains(extra_books, b), "character-bound (additional)")
    return chats.withColumn("why", why.when(b.isin(list(global_books)), "global") if global_books else why)


def attached_books(bindings: list[DataFrame], books: DataFrame) -> DataFrame:
    """(chat_id, world): the union of bindings (chat_id, world) that name an existing book."""
    out = bindings[0].select("chat_id", "world")
    for b in bindings[1:]:
        out = out.unionByName(b.select("chat_id", "world"))
    return out.filter(F.coalesce("world", F.lit("")) != "").distinct().join(books.select("world"), "world", "left_semi")


def book_fingerprints(entries: DataFrame) -> DataFrame:
    """(world, entries, chars, fingerprint): order-insensitive, by the contents of the enabled entries."""
    live = entries.filter(~F.coalesce("disable", F.lit(False)) & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    h = F.xxhash64("world", "uid", "content")
    return live.groupBy("world").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.length("content")).alias("chars"), F.bit_xor(h).alias("fingerprint"))


def index_fingerprints(entries: DataFrame, mode: str = "paragraph", size: int = 1750, least: int = 120) -> DataFrame:
    """(world, fingerprint) of the enabled entries with content, as ``count:chars:hash:mode:size:least``; the hash is a sum, so the order of entries doesn't count."""
    live = entries.filter(~F.coalesce("disable", F.lit(False)) & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    units = F.size(code_units(F.col("content")))
    h = fnv1a(F.concat_ws("\x1f", "world", F.col("uid").cast("string"), "content"))
    s = live.groupBy("world").agg(F.count(F.lit(1)).alias("n"), F.sum(units).alias("chars"), (F.sum(h) % (1 << 32)).alias("h"))
    return s.select("world", F.concat_ws(":", F.col("n").cast("string"), F.col("chars").cast("string"), hex32(F.col("h").cast("long")), F.lit(mode), F.lit(str(size)), F.lit(str(least))).alias("fingerprint"))

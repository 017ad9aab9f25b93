"""Bulk edits of key lists as column rewrites; each returns the entries with a flag ``edited``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _norm(c: Column) -> Column:
    return F.trim(F.lower(c))


def _holds(keys: Column, term: str) -> Column:
    return F.coalesce(F.exists(keys, lambda k: _norm(k) == term.strip().lower()), F.lit(False))


def _with(entries: DataFrame, col: str, after: Column) -> DataFrame:
    return entries.withColumn("edited", ~after.eqNullSafe(F.col(col))).withColumn(col, after)


def holders(entries: DataFrame, key: str, col: str = "key") -> DataFrame:
    return entries.filter(_holds(F.col(col), key))


def delete_key(entries: DataFrame, key: str, col: str = "key") -> DataFrame:
    return _with(entries, col, F.filter(F.col(col), lambda k: F.coalesce(_norm(k) != key.strip().lower(), F.lit(True))))


def rename_key(entries: DataFrame, old: str, new: str, col: str = "key") -> DataFrame:
    """The first holder of ``old`` in each list becomes ``new``; where another key of the list reads as ``new``, ``old`` goes instead."""
    keys = F.col(col)
    at = F.array_position(F.transform(keys, lambda k: F.coalesce(_norm(k), F.lit(""))), old.strip().lower())
    others = F.exists(F.transform(keys, lambda k, i: (i + 1 != at) & (F.coalesce(_norm(k), F.lit("")) == new.strip().lower())), lambda x: x)
    renamed = F.transform(keys, lambda k, i: F.when(i + 1 == at, F.lit(new)).otherwise(k))
    dropped = F.flatten(F.transform(keys, lambda k, i: F.when(i + 1 == at, F.array().cast("array<string>")).otherwise(F.array(k))))
    return _with(entries, col, F.when(F.coalesce(at, F.lit(0)) == 0, keys).when(others, dropped).otherwise(renamed))


def add_variant(entries: DataFrame, key: str, term: str, col: str = "key") -> DataFrame:
    keys = F.col(col)
    return _with(entries, col, F.when(_holds(keys, key) & ~_holds(keys, term), F.concat(keys, F.array(F.lit(term)))).otherwise(keys))


def add_secondary(entries: DataFrame, term: str) -> DataFrame:
    """The term as a secondary key where it is none yet; the first one turns the gate on."""
    sec = F.coalesce("keysecondary", F.array().cast("array<string>"))
    out = _with(entries, "keysecondary", F.when(_holds(sec, term), F.col("keysecondary")).otherwise(F.concat(sec, F.array(F.lit(term)))))
    return out.withColumn("selective", F.when(F.col("edited") & (F.size("keysecondary") == 1), True).otherwise(F.col("selective"))) if "selective" in entries.columns else out


def reindex_plan(entries: DataFrame, chosen: DataFrame, start: int, descending: bool = False) -> tuple[DataFrame, DataFrame]:
    """((world, uid, target), conflicts): chosen rows (world, uid, place from 0) of a book moved to a dense block of uids; conflicts are
    entries outside the choice that hold a target."""
    n = chosen.groupBy("world").agg(F.count(F.lit(1)).alias("n"))
    target = F.lit(start) + (F.col("n") - 1 - F.col("place") if descending else F.col("place"))
    moves = chosen.join(n, "world").select("world", "uid", target.cast("long").alias("target"))
    rest = entries.select("world", "uid").join(chosen.select("world", "uid"), ["world", "uid"], "left_anti")
    return moves, rest.join(moves.select("world", F.col("target").alias("uid")), ["world", "uid"], "left_semi")


def rekeyed(record: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept or moved, dropped) of a state record (key, at) under simultaneous moves (key, target); a null target drops, a moved row displaces one at its target."""
    j = record.join(moves.withColumn("_m", F.lit(True)), "key", "left")
    stays = (F.col("_m").isNull()) | (F.col("target") == F.col("key"))
    kept = j.filter(stays).select("key", "at")
    going = j.filter(~F.coalesce(stays, F.lit(False)))
    moved = going.filter("target IS NOT NULL").groupBy("target").agg(F.min(F.struct("key", "at")).alias("s")).select(F.col("target").alias("key"), F.col("s.at").alias("at"), F.col("s.key").alias("_from"))
    lost = kept.join(moved.select("key"), "key", "left_semi").unionByName(going.join(moved.select(F.col("_from").alias("key")), "key", "left_anti").select("key", "at"))
    return kept.join(moved.select("key"), "key", "left_anti").unionByName(moved.select("key", "at")), lost

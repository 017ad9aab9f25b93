"""Session helpers: tables, the shared folder, and materialised intermediate results."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The test table of that name; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Taken from ``spark.checkpoint.dir``; only where that is unset and all executors are
    threads of this machine (tests) is a temporary folder made and set as the checkpoint folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
        if current:
            return current.rstrip("/")
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lorelake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{folder}")
        return f"file://{folder}"
    return folder.rstrip("/")


_moves = re.compile(r"\b(?:Join|Aggregate|Window|Sort|Repartition\w*|Distinct|Generate|GlobalLimit)\b")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it is a plain scan of fewer splits; else ``df`` as it is.

    For Arrow stages that cost far more than reading their rows: a table of one small file would keep one core busy. A large table has more
    splits than cores and isn't touched.
    """
    query = df._jdf.queryExecution()
    if _moves.search(query.optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if query.toRdd().getNumPartitions() < cores else df


def beside(held: DataFrame, rows: DataFrame, by: str, apart: str, least: int = 2048) -> DataFrame:
    """The rows of both tables, all of a value of ``by`` in one stream of one task, its ``held`` rows ahead of its ``rows`` (``second`` is true, in the order of ``apart``).

    For an Arrow stage that keeps what is held of one value. Columns that one table lacks are null. A value with more than a quarter of a partition's
    part of ``rows`` is cut into shares by the hash of the column ``apart``, each beside all that is held of it. There are at most four such values a partition, so the plan holds their list.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    most = max(least, (sizes.agg(F.sum("n")).first()[0] or 0) // (4 * n))
    large = {r[by]: -(-r["n"] // most) for r in sizes.filter(F.col("n") > most).collect() if r[by] is not None}  # at most 4n
    told = F.create_map(*[F.lit(x) for pair in large.items() for x in pair]) if large else None
    shares = F.coalesce(F.try_element_at(told, F.col(by)), F.lit(1)) if large else F.lit(1)
    held = held.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).withColumn("second", F.lit(False))
    rows = rows.withColumn("share", F.pmod(F.xxhash64(apart), shares).cast("int")).withColumn("second", F.lit(True))
    both = held.unionByName(rows, allowMissingColumns=True).filter(F.col(by).isNotNull())
    return both.repartition(n, by, "share").sortWithinPartitions(by, "share", "second", apart)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str, partition_by: list[str] | None = None, instead: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder as Parquet and read it back.

    Cuts lineage like a checkpoint, but compressed, columnar and splittable, so that each reader takes only the columns it needs; and what the
    planner knows of it is the size of its files, where a checkpoint keeps the estimate of the plan it came from, which grows without end
    in a loop of joins. ``instead`` is an earlier result of this function that ``df`` takes the place of; its files are deleted.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if instead is not None:
        dropped(instead)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a result of ``stored``; whatever still reads them fails."""
    if path := getattr(df, "_stored_at", None):
        _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete all that this application has stored. To be called when its results are written; the folder is not emptied otherwise."""
    _delete(spark, _own_dir(spark))

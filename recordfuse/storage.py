"""What a run leaves on disk on its way: tables in the folder that driver and executors share, and joins that split hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a task gets in ``spread_join``, and the number of keys that are split at most (the most frequent ones),
#: which bounds what is broadcast for it to some megabytes.
HOT, MOST_HOT = 1024, 100_000

_open: list[list[str]] = []


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="recordfuse-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Without one: a temporary folder if all runs on this machine, as
    in tests; an error on a cluster."""
    named = spark.sparkContext._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or (named.get() if named.isDefined() else None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = _own_folder()
    return at.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder. It is deleted with the step that asked for it (``settled``), else when the session ends."""
    path = f"{shared_dir(spark)}/recordfuse/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    p, files = _file_system(spark, path)
    files.delete(p, True)


def files_at(spark: SparkSession, folder: str, pattern: str) -> list[str] | None:
    """Names of the files of a folder that fit the pattern, sorted; None without the folder."""
    p, files = _file_system(spark, folder)
    if not files.exists(p):
        return None
    found = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")) or []
    return sorted(str(f.getPath().getName()) for f in found)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, outlives executors, is computed once; readers of the table
    prune its columns and know its size."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    p, files = _file_system(spark, path)
    files.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, as a table; the tables that it wrote on its way are deleted."""
    _open.append([])
    try:
        df = make()
        made = _open.pop()
        out = written(df, name)
        _open.append(made)
    finally:
        for path in _open.pop():
            drop_folder(spark, path)
    return out


def spread_join(big: DataFrame, small: DataFrame, key: str, by: list[str | Column], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small``. ``counts`` (``key``, n) says how many rows of ``big`` hold a key; without it ``small`` does, in n,
    and has one row for each key. The rows of a key that over ``HOT`` hold are dealt by ``by`` to as many tasks as they need, and
    ``small``'s rows to each of those."""
    counts = small if counts is None else counts
    hot = counts.filter(F.col("n") > HOT).select(key, "n", F.ceil(F.col("n") / HOT).cast("int").alias("_parts")).orderBy(F.desc("n")).limit(MOST_HOT)
    hot = F.broadcast(hot.select(key, "_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    left = big.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")
    right = small.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")

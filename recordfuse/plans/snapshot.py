"""Run ids and immutable snapshots of a run's candidates."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def make_run_id(paths: list[str], ts: str) -> str:
    said = json.dumps({"sources": sorted(paths), "ts": ts}, sort_keys=True)
    return hashlib.sha256(said.encode()).hexdigest()[:12]


def _at(folder: str, run_id: str) -> str:
    return f"{folder.rstrip('/')}/canonical_{run_id}"


def write_snapshot(candidates: DataFrame, folder: str, run_id: str, written_at: str) -> str | None:
    """Candidates as Parquet and a manifest beside them. A run that is there already stays as it is; None on failure."""
    at = _at(folder, run_id)
    try:
        candidates.write.mode("errorifexists").parquet(f"{at}/candidates")
        said = candidates.sparkSession.read.parquet(f"{at}/candidates").agg(F.count("*").alias("candidate_count")).select(F.lit(run_id).alias("run_id"), F.lit(written_at).alias("written_at"), "candidate_count")
        said.coalesce(1).write.mode("errorifexists").json(f"{at}/manifest")
    except Exception:  # noqa: BLE001  a run's result does not depend on its snapshot
        return None
    return at


def read_snapshot(spark: SparkSession, folder: str, run_id: str) -> DataFrame | None:
    at = _at(folder, run_id)
    return spark.read.parquet(f"{at}/candidates") if _exists(spark, f"{at}/manifest/_SUCCESS") else None


def list_snapshots(spark: SparkSession, folder: str) -> list[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/canonical_*")
    found = pattern.getFileSystem(conf).globStatus(pattern) or []
    return sorted(str(f.getPath().getName()).removeprefix("canonical_") for f in found)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_projected(lines: DataFrame, path: str) -> None:
    """JSON lines of ``projection.as_json``."""
    lines.write.mode("errorifexists").text(path)

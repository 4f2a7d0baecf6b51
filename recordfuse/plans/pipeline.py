"""A whole run: read, link, fuse, keep, project."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fusion import merge
from ..storage import files_at, written
from ..operators.linkage import resolve
from ..sources import readers
from .projection import Projection, as_json, project
from .snapshot import make_run_id, write_projected, write_snapshot


@dataclass
class RunResult:
    candidates: DataFrame | None = None
    projected: DataFrame | None = None
    projection_errors: DataFrame | None = None
    errors: list[str] = field(default_factory=list)
    sources_processed: list[str] = field(default_factory=list)
    sources_skipped: list[str] = field(default_factory=list)
    snapshot_path: str | None = None
    run_id: str | None = None


#: Kinds that have a file for each record, by the files' pattern.
FOLDERS = {"recruiter_notes": "*.txt", "resume": "*"}


def _share(spark: SparkSession, kind: str, path: str, used: int) -> str:
    """How many of a folder's files gave a record."""
    names = files_at(spark, path, FOLDERS[kind]) if kind in FOLDERS and "*" not in path else None
    return f", {used}/{len(names)} files" if names else ""


def _missing(spark: SparkSession, kind: str, path: str) -> str:
    """What is known of a folder that gave nothing."""
    if kind not in FOLDERS or "*" in path:
        return ""
    names = files_at(spark, path, FOLDERS[kind])
    return ": directory missing" if names is None else ": no files found" if not names else ": 0 files yielded usable records"


def run(spark: SparkSession, inputs: dict[str, str], how: Projection | None = None, output: str | None = None, run_ts: str | None = None, as_of: str | None = None, projected: str | None = None) -> RunResult:
    """``inputs``: kind of source to path. A source that cannot be read, whatever its reader raises, is skipped, with the reason;
    without any records the run ends early. ``projected``: where JSON lines of the projection go."""
    out, found = RunResult(), []
    for kind, reader in readers.REGISTRY.items():
        if kind not in inputs:
            continue
        try:
            records = written(reader(spark, inputs[kind]), "records")
            n, files = records.agg(F.count("*"), F.countDistinct("source_id")).first()
        except Exception as e:  # noqa: BLE001  one source does not end the run
            out.errors.append(f"{kind}: {type(e).__name__}")
            out.sources_skipped.append(f"{kind} (unreadable{_missing(spark, kind, inputs[kind])})")
            continue
        if n:
            found.append(records)
            out.sources_processed.append(f"{kind} ({n} records{_share(spark, kind, inputs[kind], files)})")
        else:
            out.sources_skipped.append(f"{kind} (empty or missing{_missing(spark, kind, inputs[kind])})")
    if not found:
        out.errors.append("no records")
        return out
    records = readers.union_sources(found)
    day = F.lit(as_of).cast("date") if as_of else None
    # Computed once: the snapshot, the projection and the caller all read it.
    out.candidates = written(merge(records, resolve(records), day), "candidates")
    ts = run_ts or datetime.datetime.now(datetime.UTC).isoformat()
    out.run_id = make_run_id(list(inputs.values()), ts)
    if output:
        out.snapshot_path = write_snapshot(out.candidates, output, out.run_id, ts)
    out.projected, out.projection_errors = project(out.candidates, how)
    if projected:
        write_projected(as_json(out.projected, how.on_missing if how else "null"), projected)
    return out

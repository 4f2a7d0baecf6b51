"""What the operators of this subpackage share: workers, batches, columns whose names do not clash."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a worker turns into Python objects at once. (Spark itself bounds the bytes of an Arrow batch.)
ROWS = 512

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Makes the package importable on executors."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="recordfuse-")) / "recordfuse_workers.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A batch from tuples."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def named(column: str) -> Column:
    """The column of that name, whatever characters the name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def others(df: DataFrame, *added: str) -> list[str]:
    """The columns that stay beside the added ones. Names are compared as Spark does, without regard to case: of a clash the
    added column remains."""
    taken = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in taken]


def spare(df: DataFrame, name: str) -> str:
    """A name like this one that no column has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine (asked on each worker, since paths may differ)."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))

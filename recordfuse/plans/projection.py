"""A small projection language, compiled to a select.

A path is ``a``, ``a.b``, ``a[i]`` (from 0), ``a[]`` (the whole list; what follows in the path is not looked at), or ``a[] sub`` (that
part of every element). What the schema does not have is null.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLICIES = ("null", "omit", "error")
_STEP = re.compile(r"^(\w+)(?:\[(\d*)\])?(?:\s+(\w+))?$")


@dataclass(frozen=True)
class FieldSpec:
    path: str
    type: str = "string"
    source: str | None = None
    normalize: str | None = None
    required: bool = False


@dataclass(frozen=True)
class Projection:
    fields: tuple[FieldSpec, ...] = ()
    include_confidence: bool = False
    include_provenance: bool = False
    on_missing: str = "null"


def load(raw: str | dict) -> Projection:
    """From JSON text or a dictionary; ValueError where it is not a projection."""
    data = json.loads(raw) if isinstance(raw, str) else raw
    if not isinstance(data, dict) or not isinstance(data.get("fields", []), list):
        raise ValueError("a projection is an object with a list of fields")
    policy = data.get("on_missing", "null")
    if policy not in POLICIES:
        raise ValueError(f"on_missing is one of {', '.join(POLICIES)}")
    specs = []
    for f in data.get("fields", []):
        if not isinstance(f, dict) or not isinstance(f.get("path"), str):
            raise ValueError("a field is an object with a path")
        specs.append(FieldSpec(f["path"], f.get("type", "string"), f.get("from"), f.get("normalize"), bool(f.get("required", False))))
    return Projection(tuple(specs), bool(data.get("include_confidence", False)), bool(data.get("include_provenance", False)), policy)


def _part(name: str):
    return lambda x: x[name]


def _about(base: str):
    return lambda p: p.field.startswith(base)


def compile_path(path: str, schema: T.StructType) -> tuple[Column, T.DataType]:
    at: Column | None = None
    kind: T.DataType = schema
    nothing = (F.lit(None).cast("string"), T.StringType())
    for segment in path.strip().split("."):
        m = _STEP.match(segment.strip())
        if not m or not isinstance(kind, T.StructType) or m[1] not in kind.fieldNames():
            return nothing
        at = F.col(f"`{m[1]}`") if at is None else at.getField(m[1])
        kind = kind[m[1]].dataType
        if m[2] is None:
            continue
        if not isinstance(kind, T.ArrayType):
            return nothing
        if m[2]:
            at, kind = F.get(at, F.lit(int(m[2]))), kind.elementType
        elif m[3]:
            if not isinstance(kind.elementType, T.StructType) or m[3] not in kind.elementType.fieldNames():
                return nothing
            sub = kind.elementType[m[3]].dataType
            whole = F.filter(F.transform(at, _part(m[3])), lambda x: x.isNotNull())
            return F.when(F.size(whole) > 0, whole), T.ArrayType(sub)
        else:
            return at, kind
    return (at, kind) if at is not None else nothing


def missing(c: Column, kind: T.DataType) -> Column:
    gone = c.isNull()
    if isinstance(kind, T.ArrayType):
        gone = gone | (F.size(c) == 0)
    if isinstance(kind, T.StringType):
        gone = gone | (c == "")
    return gone


def project(candidates: DataFrame, how: Projection | None = None) -> tuple[DataFrame, DataFrame]:
    """(projected rows, errors). Without fields all columns. A column holds null for what is missing; as JSON, see
    ``as_json``, ``omit`` leaves it out. Under ``error`` a row that lacks a required field is an error instead of a row."""
    how = how or Projection()
    schema = candidates.schema
    if not how.fields:
        return candidates, candidates.select("candidate_id", F.lit(None).cast("string").alias("error")).limit(0)
    made, lacking = [], F.lit(False)
    for f in how.fields:
        c, kind = compile_path(f.source or f.path, schema)
        if f.normalize == "E164" and isinstance(kind, T.StringType):
            c = F.when(c.startswith("+"), c)
        gone = missing(c, kind)
        if f.required:
            lacking = lacking | gone
        made.append(F.when(~gone, c).alias(f.path))
        base = re.split(r"[\[.]", f.source or f.path)[0]
        own = F.filter("provenance", _about(base))
        if how.include_confidence:
            mean = F.aggregate(own, F.lit(0.0), lambda a, p: a + p.confidence) / F.size(own)
            made.append(F.when(~gone & (F.size(own) > 0), F.round(mean, 4)).alias(f"{f.path}_confidence"))
        if how.include_provenance:
            made.append(F.when(~gone, F.transform(own, lambda p: F.struct(p.source.alias("source"), p.method.alias("method"), p.confidence.alias("confidence")))).alias(f"{f.path}_provenance"))
    good = candidates.filter(~lacking) if how.on_missing == "error" else candidates
    bad = candidates.filter(lacking) if how.on_missing == "error" else candidates.limit(0)
    return good.select(*made), bad.select("candidate_id", F.concat(F.lit("projection_failed for candidate_id="), F.col("candidate_id")).alias("error"))


def as_json(projected: DataFrame, on_missing: str = "null") -> DataFrame:
    """(value): one JSON object a row, with nulls or, under ``omit``, without."""
    keep = "true" if on_missing == "omit" else "false"
    return projected.select(F.to_json(F.struct("*"), {"ignoreNullFields": keep}).alias("value"))

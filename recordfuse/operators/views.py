"""What a user interface asks of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(confidence: Column) -> Column:
    return F.round(confidence * 100).cast("int")


def location_text(c: Column) -> Column:
    return F.concat_ws(", ", c["city"], c["region"], c["country"])


def degree_text(c: Column) -> Column:
    return F.concat_ws(" in ", c["degree"], c["field"])


def search(candidates: DataFrame, query: str) -> DataFrame:
    """Candidates whose name, headline, place or skills hold the query, in any case."""
    q = query.strip().lower()
    fields = [F.col("full_name"), F.col("headline"), location_text(F.col("location")), F.array_join(F.transform("skills", lambda s: s["name"]), " ")]
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(f), F.lit(q)), F.lit(False))
    return candidates.filter(hit)


def summary(candidates: DataFrame, errors: int = 0, sources: int = 0) -> DataFrame:
    mean = F.coalesce(percent(F.avg("overall_confidence")), F.lit(0))
    return candidates.agg(F.count("*").alias("n_candidates"), mean.alias("avg_trust"), F.lit(errors).cast("long").alias("n_errors"), F.lit(sources).cast("long").alias("n_sources"))


def with_sources(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("sources", F.array_distinct("source_records_merged"))

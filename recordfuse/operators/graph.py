"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def star_labels(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) reaches. Large and small stars in turn, each round a table
    of its own; the number of rounds grows with the logarithm of the longest path. The many edges of a star's centre meet its
    smallest neighbour in an inner join, whose large partitions adaptive execution splits."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    least = lambda x: x.groupBy("u").agg(F.min("v").alias("m"))
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        joined = large.join(least(large), "u")
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        new = written(joined.select(F.explode(ends).alias("x")).select("x.*").filter("u <> v").distinct(), "edges")
        if _stars(new):
            return new.select(F.col("u").alias("id"), F.col("v").alias("component")).union(new.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        e = new


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one centre, and no centre on another: such edges, which run to smaller ids, are the components."""
    ends = edges.select("u", F.lit(1).alias("n")).union(edges.select(F.col("v").alias("u"), F.lit(None).cast("int")).distinct())
    kinds = ends.groupBy("u").agg(F.count("n").alias("own"), F.count("*").alias("all"))
    return kinds.filter("own > 0 and all > 1").isEmpty()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for nodes (id) and edges (a, b): the smallest id that a node reaches, its own without edges."""
    return nodes.select("id").join(star_labels(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))

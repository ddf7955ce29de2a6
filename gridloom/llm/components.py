"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.shared import materialise


def _print(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """Table ``(id, component)`` of every end of ``edges(u, v)`` (long); the component is its smallest id.

    Alternates large-star and small-star steps: every node hands its larger, then its smaller neighbours to the smallest
    one. Only minima per node are aggregated, which combine before the shuffle, so a node with very many neighbours is
    no task of its own; the joins are ordinary equality joins that AQE splits. Every round is written to the shared
    folder. The rounds grow with the logarithm of the longest chain.
    """
    ordered = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    current = materialise(ordered, "links")
    seen = _print(current)
    while seen[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # From here u < v: the smaller neighbours of v.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"))
        current = materialise(small.where("u <> v").distinct(), "links")
        now = _print(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("u").alias("id"), F.col("u").alias("component"))
    return current.select(F.col("v").alias("id"), F.col("u").alias("component")).union(roots).distinct()

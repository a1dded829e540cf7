"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``, one row per node of an edge; root is the smallest node it reaches.

    Alternating large-star and small-star rounds: every node links its larger (then its smaller)
    neighbours to the smallest neighbour it knows, until nothing changes. The number of rounds grows
    with the logarithm of the longest path. Each round is a partially aggregated minimum and one join on
    the node, and is written to the shared folder, so a lost executor costs one round at most.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct(), name)
    state = mark(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                            F.col("m").alias("v")).distinct()
        links = written(small, name)
        now = mark(links)
        if now == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def mark(links: DataFrame) -> tuple:
    """A digest of the edge set that does not depend on row order."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

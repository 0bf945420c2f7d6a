"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.llm.shared import written


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(id, component)`` for every id in ``edges(a, b)``: the smallest id that it reaches.

    Each round hangs neighbours on the smallest one; rounds grow with the logarithm of the size of
    a component. Minima are taken by partial aggregates and joined back, so that a vertex with very
    many edges is never gathered. Edges with a null end, loops and repeats are ignored.
    """
    found = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    seen = None
    while True:
        both = found.union(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        )
        found = written(small, name)
        state = found.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    members = found.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.union(members.select(F.col("component").alias("id"), "component").distinct())

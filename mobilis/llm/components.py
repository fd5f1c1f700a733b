"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilis.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps: each replaces a node's links
    by links to the smallest neighbour, until every node points at its
    component. Minima are aggregates, so a node with very many links is
    combined before it is shuffled; each round is written to the shared folder.
    """
    links = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).where("v != w").distinct()
    links = stored(links, "components")
    before = None
    while True:
        both = links.select(F.col("v").alias("u"), F.col("w").alias("n")).union(links.select(F.col("w"), F.col("v")))
        low = both.groupBy("u").agg(F.min("n").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("n > u").join(low, "u").select(F.col("n").alias("v"), F.col("m").alias("w")).distinct()
        lowest = large.groupBy("v").agg(F.min("w").alias("m"))
        small = (large.join(lowest, "v").where("w != m").select(F.col("w").alias("v"), F.col("m").alias("w"))
                 .union(lowest.select("v", F.col("m").alias("w"))).where("v != w").distinct())
        links = stored(small, "components")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "w").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = links.groupBy(F.col("v").alias("node")).agg(F.min("w").alias("component"))
    return found.union(found.select("component", "component").distinct())

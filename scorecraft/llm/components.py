"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import stage


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, label`` for every node of ``links`` (columns ``a, b``); the
    label is the smallest node of the component.

    Each step points nodes at the smallest neighbour: the number of rounds
    grows with the logarithm of a component's size. Minima are partial
    aggregates, so a node with very many links is summed before the shuffle;
    the joins with them are plain equi-joins that AQE may split. Every round is
    a written table.
    """
    edges = stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct(),
        name,
    )
    before = None
    while True:
        # large star: greater neighbours go to the smallest of all neighbours and the node itself
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter(F.col("u") != F.col("v")).distinct(), name)
        # small star: smaller neighbours and the node itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
        edges = stage(small.filter(F.col("u") != F.col("v")).distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )

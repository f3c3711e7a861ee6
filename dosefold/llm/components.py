"""Connected components of link tables, by turns of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosefold.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); the component is its smallest node.

    Every turn links nodes to the smallest neighbour they know; links are
    counted and hashed to see when nothing changes, and never leave Spark.
    Smallest neighbours are found by an aggregate and joined back, so a node
    with very many links is summed before the shuffle and split in the join.
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").where("b > a AND b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = stored(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = stored(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), "links")
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

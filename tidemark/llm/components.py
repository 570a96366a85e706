"""Connected components by alternating star steps: no node's neighbours meet in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _largest_first(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """Smallest node that each linked node can reach: node, root.

    ``links`` has two columns of one orderable type.  A large-star step links each
    larger neighbour of a node to the node's smallest neighbour, a small-star step
    links a node and its smaller neighbours to the smallest of them; both keep the
    components and end, after about log(n) rounds, in stars.  A round is two
    grouped minima (combined before the shuffle) and two joins, written to the
    shared folder; the driver sees a count and a checksum only.
    """
    u, v = links.columns
    edges = stored(_largest_first(links.select(F.col(u).alias("u"), F.col(v).alias("v"))), "links")
    before = None
    while (now := _signature(edges)) != before:
        before = now
        both = edges.union(edges.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
        large = stored(_largest_first(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = stored(_largest_first(small), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

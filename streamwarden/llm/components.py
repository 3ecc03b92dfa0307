"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable from each node of ``a, b``.

    Each round ties every node's larger neighbours to its smallest one (large star), then
    its smaller neighbours and itself to the smallest (small star), until nothing
    changes: a number of rounds in the logarithm of the nodes, none of which gathers a
    node's neighbours in one task. Links of a node with itself and repeated links are no
    matter; without links there are no rows.
    """
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .union(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return labels.union(roots).distinct()

"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrava.session import materialize_observed, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect neighbours (the larger ones, or the smaller ones and the node) to the least node around."""
    if large:
        around = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        around = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = around.groupBy("src").agg(F.min("dst").alias("low")).withColumn("low", F.least("src", "low"))
    joined = around.join(least, "src")
    if large:
        linked = joined.filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        linked = joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(
            least.select("src", F.col("low").alias("dst"))
        )
    return linked.filter("src <> dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with the least node of each component; edges are (src, dst), in any direction.

    Null ends and loops are dropped. Every step moves about one row per edge and no node's
    neighbourhood is gathered, so hubs are harmless. Rounds grow with the logarithm of the
    longest path.
    """
    # Edges are distinct, so their number and the sum of their hashes tell whether a round changed any.
    marks = F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")
    edges, before = materialize_observed(edges.select("src", "dst").filter("src <> dst").distinct(), "cc", *marks)
    while True:
        step, now = materialize_observed(_star(_star(edges, True), False), "cc", *marks)
        release(edges)
        edges = step
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return nodes.union(roots)

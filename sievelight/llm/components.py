"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import discard, materialize


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them and itself: the larger ones, or the smaller ones."""
    if larger_only:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        linked = near.filter("v > u").join(low, "u").select(F.col("v").alias("x"), "m")
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = near.groupBy("u").agg(F.min("v").alias("m"))
        linked = near.join(low, "u").select(F.col("v").alias("x"), "m").unionByName(low.select(F.col("u").alias("x"), "m"))
    return linked.filter("x != m").select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a, b) -> (node, root): root is the smallest node that node reaches. Nodes without a link are absent.

    Each round writes its links to the shared folder and deletes those of the round before; nothing is collected.
    A node that many others link to is one row on one side of each join, so Spark can split its partition.
    """
    edges = materialize(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        digest = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if digest == seen or digest[0] == 0:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        seen = digest
        after = materialize(_star(_star(edges, True), False), "cc")
        discard(edges)
        edges = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

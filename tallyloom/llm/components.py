"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import durable


def _star(edges: DataFrame) -> DataFrame:
    """Each node's neighbours with the least node among them and the node itself."""
    least = durable(
        edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return edges.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the least node it can reach; only nodes that have an edge.

    ``edges`` has long columns a and b. Every round stores its edges in the shared folder; a
    node's neighbours are folded to their minimum, never gathered. Rounds grow with the
    logarithm of the longest path. No edges: an empty table.
    """
    current = durable(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = durable(
            _star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct(), "edges")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = _star(down)
        current = durable(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        sign = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == seen:
            return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        seen = sign

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hangs each node's neighbours (its larger ones, or itself and its smaller ones) on its smallest."""
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if small:
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        hung = both.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return hung.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
    both = both.union(both.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, where: str) -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node that it reaches.

    edges: two columns a, b of integers; order, repeats and loops don't matter.
    Each round is a table in the shared folder `where`; the driver sees its count
    and checksum only.
    """
    now, before, k = written(edges.select("a", "b").where("a <> b").distinct(), where, "edges-0"), None, 0
    while True:
        k += 1
        nxt = written(_star(_star(now, small=False), small=True), where, f"edges-{k}")
        mark = nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if k > 1:
            remove(edges.sparkSession, f"{where}/edges-{k - 2}")
        if mark == before:
            break
        now, before = nxt, mark
    labels = nxt.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.union(nxt.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))

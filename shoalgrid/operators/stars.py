"""Connected components of an edge table by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgrid.lineage import cut, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a, b), a > b: every node's neighbours (large: the larger ones; small: the smaller ones and itself) go to its smallest."""
    around = edges.select("a", "b")
    if large:
        around = around.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = around.join(least, "a")  # hot centres are split by the skew join
    if large:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node that has an edge. edges: a, b of one orderable type, without nulls."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        before, now = now, cut(_star(_star(now, True), False), "edges")
        drop(before)
        if (found := mark(now)) == seen:
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

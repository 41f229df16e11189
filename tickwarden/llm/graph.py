"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.session import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, root): every node that has an edge, and the smallest node it is connected with.

    Alternates two steps until nothing changes: each node hands its larger neighbours to its smallest one, then each
    node joins its smaller neighbours with the smallest of them. Paths halve in each round and edges never grow in
    number. A node's edges are never gathered: minima are aggregated, edges are joined with them. Every round is written
    to the shared folder. Self-loops, repeated edges and an empty table are fine.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", "low"), F.struct(F.col("b").alias("a"), F.col("low")))).alias("e"))
        after = cut(small.select(F.col("e.a").alias("a"), F.col("e.low").alias("b")).filter("a <> b").distinct())
        after_mark = _mark(after)
        if after_mark == mark:
            break
        now, mark = after, after_mark
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

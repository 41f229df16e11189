"""Shortest and simple paths for tables of (source, target) pairs.

A node with one link can only be the first or last node of a path, so expansion runs on the rest of the network
and the last link is joined by (node, target).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.operators.topology import both_directions, degrees
from tickwarden.session import cut


def _arcs(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all directed arcs, the arcs into nodes with at least two links)."""
    links = cut(links.select("source", "target", "weight"))
    arcs = both_directions(links.select("source", "target", "weight")).withColumnsRenamed({"source": "node", "target": "next"})
    inner = degrees(links.withColumn("link_id", F.lit(""))).where(F.col("degree") > 1).select(F.col("node_id").alias("next"))
    return arcs, arcs.join(inner, "next", "left_semi")


def shortest_paths(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cheapest path per pair by weight (not negative), of any length; the smallest path text among equals.

    Expansion is per distinct source, keeping the best row per (source, node), and goes on from the rows that the last
    round made better until there are none.
    """
    arcs, inner = _arcs(links)
    wanted = pairs.select("source", "target").distinct()
    state = wanted.select("source").distinct().select(
        "source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"),
        F.col("source").alias("path"),
    )
    best = F.min(F.struct(F.round("cost", 9).alias("_c"), "path", "cost", "hops", "fresh"))
    state, hop = state.withColumn("fresh", F.lit(0)), 0
    while hop == 0 or not state.where(F.col("fresh") == hop).isEmpty():
        grown = state.where(F.col("fresh") == hop).join(inner, "node").select(
            "source", F.col("next").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"),
            (F.col("hops") + 1).alias("hops"), F.concat_ws(">", "path", "next").alias("path"), F.lit(hop + 1).alias("fresh"),
        )
        state = state.unionByName(grown).groupBy("source", "node").agg(best.alias("b"))
        state = cut(state.select("source", "node", "b.cost", "b.hops", "b.path", "b.fresh"))
        hop += 1
    last = wanted.join(arcs.withColumnRenamed("next", "target"), "target").join(state, ["source", "node"])
    last = last.where(F.col("source") != F.col("target")).select(
        "source", "target", (F.col("cost") + F.col("weight")).alias("cost"), (F.col("hops") + 1).alias("hops"),
        F.concat_ws(">", "path", "target").alias("path"), "fresh",
    )
    found = last.groupBy("source", "target").agg(best.alias("b"))
    return found.select("source", "target", "b.cost", "b.hops", "b.path")


def simple_paths(links: DataFrame, pairs: DataFrame, max_hops: int = 6) -> DataFrame:
    """Every loop-free path of at most `max_hops` links between the ends of each pair."""
    arcs, inner = _arcs(links)
    arrive = arcs.select("node", F.col("next").alias("target"))
    live = pairs.select("source", "target").distinct().select(
        "source", "target", F.col("source").alias("node"), F.array("source").alias("path")
    )
    done = None
    for hop in range(max_hops):
        arrived = live.join(arrive, ["node", "target"]).select(
            "source", "target", F.concat("path", F.array("target")).alias("path")
        )
        done = arrived if done is None else done.unionByName(arrived)
        if hop < max_hops - 1:
            grown = live.join(inner.select("node", "next"), "node")
            fresh = ~F.array_contains("path", F.col("next")) & (F.col("next") != F.col("target"))
            live = grown.where(fresh).select(
                "source", "target", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")
            )
            if hop % 2 == 1:
                live = cut(live)
    return done


def path_counts(links: DataFrame, pairs: DataFrame, max_hops: int = 6) -> DataFrame:
    counted = simple_paths(links, pairs, max_hops).groupBy("source", "target").agg(F.count("*").alias("paths"))
    wanted = pairs.select("source", "target").distinct()
    return wanted.join(counted, ["source", "target"], "left").select("source", "target", F.coalesce("paths", F.lit(0)).alias("paths"))


def second_paths(links: DataFrame, max_hops: int = 6) -> DataFrame:
    """(link_id, second): whether the ends of each link are joined by another path of at most `max_hops` links.

    The shortest way around a link is looked for hop by hop, from one end of each link to the other without the link
    itself. A (link, node) pair is visited once, so that rows are bounded by links x nodes in reach and no path is written
    out. A link at a node without another link needs no search.
    """
    arcs = cut(links.select("link_id", F.col("source").alias("node"), F.col("target").alias("next")).unionByName(
        links.select("link_id", F.col("target").alias("node"), F.col("source").alias("next"))))
    inner = arcs.groupBy("node").agg(F.count_distinct("link_id").alias("d")).where("d > 1").select("node")
    ends = links.select("link_id", "source", "target")
    asked = ends.join(inner.withColumnRenamed("node", "source"), "source", "left_semi").join(inner.withColumnRenamed("node", "target"), "target", "left_semi")
    frontier = cut(asked.select("link_id", "target", F.col("source").alias("node")))
    steps = arcs.select(F.col("link_id").alias("by"), "node", "next")
    visited, found = frontier.select("link_id", "node"), None
    for _ in range(max_hops):
        grown = frontier.join(steps, "node").where("by <> link_id").select("link_id", "target", F.col("next").alias("node")).distinct()
        grown = cut(grown.join(visited, ["link_id", "node"], "left_anti"))
        arrived = grown.where("node = target").select("link_id")
        found = arrived if found is None else found.unionByName(arrived)
        frontier = cut(grown.join(arrived, "link_id", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("link_id", "node"))
    return ends.select("link_id").join(found.withColumn("second", F.lit(True)), "link_id", "left").select("link_id", F.coalesce("second", F.lit(False)).alias("second"))

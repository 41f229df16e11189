"""Nodes, links and what touches what. Joins go through incidence rows; no pairs are built inside a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.functions.ids import link_id, lookup
from tickwarden.operators.series import best_rows
from tickwarden.schemas import TIER
from tickwarden.session import cut

PAIRS_PER_TASK, MAX_PAIR_TASKS = 1_000_000, 20_000


def unique_links(links: DataFrame) -> DataFrame:
    """One row per undirected link."""
    return links.withColumn("link_id", link_id(F.col("source"), F.col("target"))).dropDuplicates(["link_id"])


def both_directions(links: DataFrame) -> DataFrame:
    rest = [c for c in links.columns if c not in ("source", "target")]
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), *rest)
    return links.unionByName(back)


def incidence(links: DataFrame) -> DataFrame:
    """(node_id, link_id, neighbor), two rows per link."""
    return links.select(
        "link_id",
        F.inline(
            F.array(
                F.struct(F.col("source").alias("node_id"), F.col("target").alias("neighbor")),
                F.struct(F.col("target").alias("node_id"), F.col("source").alias("neighbor")),
            )
        ),
    )


def degrees(links: DataFrame) -> DataFrame:
    return incidence(links).groupBy("node_id").agg(F.count("*").alias("degree"))


def neighbor_lists(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sorted neighbours of the wanted nodes."""
    rows = incidence(links).join(wanted.select("node_id").distinct(), "node_id", "left_semi")
    return rows.groupBy("node_id").agg(F.array_sort(F.collect_set("neighbor")).alias("neighbors"))


def tier(node_type):
    return lookup(TIER, node_type, 3)


def directed_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add upstream and downstream: the end with the lower tier is upstream, the source on a tie."""
    kinds = nodes.select("node_id", tier(F.col("node_type")).alias("tier"))
    rows = links.join(kinds.withColumnsRenamed({"node_id": "source", "tier": "_s"}), "source", "left")
    rows = rows.join(kinds.withColumnsRenamed({"node_id": "target", "tier": "_t"}), "target", "left")
    first = F.coalesce("_s", F.lit(3)) <= F.coalesce("_t", F.lit(3))
    return rows.select(
        *links.columns,
        F.when(first, F.col("source")).otherwise(F.col("target")).alias("upstream"),
        F.when(first, F.col("target")).otherwise(F.col("source")).alias("downstream"),
    )


def neighbor_mean(links: DataFrame, nodes: DataFrame, utilization: DataFrame, default: float = 50.0) -> DataFrame:
    """Mean utilisation of the links at each node; `default` where none reports. `utilization`: link_id, value."""
    rows = incidence(links).join(utilization.select("link_id", "value"), "link_id")
    means = rows.groupBy("node_id").agg(F.avg("value").alias("m"))
    return nodes.select("node_id").join(means, "node_id", "left").select(
        "node_id", F.coalesce("m", F.lit(default)).alias("mean_utilization")
    )


def colocation_counts(links: DataFrame) -> DataFrame:
    """How many other links share a node with each link, from node degrees. Needs one row per undirected link."""
    ends = incidence(links).join(degrees(links), "node_id")
    return ends.groupBy("link_id").agg(F.sum(F.col("degree") - 1).alias("co_located"))


def attached_links(targets: DataFrame, links: DataFrame) -> DataFrame:
    """Links at each target node: (target key columns, node_id) -> link_id."""
    return targets.join(incidence(links).select("node_id", "link_id"), "node_id")


def grid(sizes: DataFrame, most: float) -> DataFrame:
    """Add _ls and _rs to (_l, _r): into how many parts to cut _l and _r rows, so that two parts give about `most` pairs.

    Rows of one side are repeated once per part of the other, least where a block has as many rows of both.
    """
    wanted = F.greatest(F.lit(1.0), F.col("_l") * F.col("_r") / F.lit(float(most)))
    even = F.greatest(F.lit(1.0), F.round(F.sqrt(wanted * F.col("_l") / F.col("_r"))))
    sizes = sizes.withColumn("_ls", F.least(even, F.ceil(wanted), "_l").cast("int"))
    return sizes.withColumn("_rs", F.least(F.ceil(wanted / F.col("_ls")), "_r").cast("int"))


def pairs_at(left: DataFrame, right: DataFrame, key: str, pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Join on `key` whose work is spread by the pairs it gives.

    A busy key's pairs are cut into a `grid` of blocks: n rows that meet n are repeated as often as the root of the number of
    blocks says. Beyond MAX_PAIR_TASKS tasks, blocks hold more pairs.
    """
    sizes = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key)
    sizes = cut(sizes.select(key, "_l", "_r"))
    pairs = sizes.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0
    sizes = cut(grid(sizes, max(pairs_per_task, pairs / MAX_PAIR_TASKS)).select(key, "_ls", "_rs"))
    tasks = max(1, min(sizes.agg(F.sum(F.col("_ls").cast("long") * F.col("_rs"))).first()[0] or 1, MAX_PAIR_TASKS))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(F.broadcast(sizes), key).withColumn(own, F.pmod(F.xxhash64(*rows.columns), F.col(own + "s")).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1))).drop("_ls", "_rs")
        # The number is given, because sizes in bytes say nothing of how many pairs a partition gives.
        return rows.repartition(tasks, key, "_l", "_r")

    return dealt(left, "_l", "_r").join(dealt(right, "_r", "_l"), [key, "_l", "_r"]).drop("_l", "_r")


def sibling_links(targets: DataFrame, links: DataFrame) -> DataFrame:
    """For chosen links, the other links at their two ends. Output is the size of the answer for those links."""
    # Links that share both their ends are paired at the first of them, so that pairs need no comparison afterwards.
    nodes = cut(incidence(links).groupBy("link_id").agg(F.array_sort(F.collect_set("node_id")).alias("_nodes")))
    chosen = targets.select(F.col("link_id").alias("target_link")).distinct()
    touched = chosen.join(nodes.select(F.col("link_id").alias("target_link"), F.col("_nodes").alias("_own")), "target_link")
    touched = cut(touched.select("target_link", "_own", F.explode("_own").alias("node_id")))
    others = pairs_at(touched, nodes.select("link_id", "_nodes", F.explode("_nodes").alias("node_id")), "node_id")
    others = others.where(F.col("link_id") != F.col("target_link"))
    return others.where(F.array_min(F.array_intersect("_own", "_nodes")) == F.col("node_id")).select("target_link", "link_id")


def sibling_load(links: DataFrame, utilization: DataFrame) -> DataFrame:
    """Per link: number of siblings and their mean utilisation, as node totals minus the link's own share."""
    own = links.select("link_id").join(utilization.select("link_id", "value"), "link_id", "left")
    ends = incidence(links).select("node_id", "link_id").join(own, "link_id")
    totals = ends.groupBy("node_id").agg(
        F.count("*").alias("n"), F.count("value").alias("k"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("s")
    )
    mine = F.coalesce("value", F.lit(0.0))
    rest = ends.join(totals, "node_id").groupBy("link_id").agg(
        F.sum(F.col("n") - 1).alias("siblings"),
        F.sum(F.col("k") - F.when(F.col("value").isNotNull(), 1).otherwise(0)).alias("k"),
        F.sum(F.col("s") - mine).alias("s"),
    )
    return rest.select(
        "link_id", "siblings", F.when(F.col("k") > 0, F.col("s") / F.col("k")).alias("mean_sibling_utilization")
    )


def alternate_link(links: DataFrame) -> DataFrame:
    """First other link at the first-named end of each link: the two smallest links per node decide it."""
    ends = incidence(links).select("node_id", "link_id")
    two = best_rows(ends, ["node_id"], [F.col("link_id")], 2, "_r")
    firsts = two.groupBy("node_id").agg(F.min("link_id").alias("_a"), F.max("link_id").alias("_b"), F.count("*").alias("_n"))
    named = links.select("link_id", F.split_part("link_id", F.lit("-"), F.lit(1)).alias("node_id"))
    rows = named.join(firsts, "node_id")
    other = F.when(F.col("_a") != F.col("link_id"), F.col("_a")).when(F.col("_n") > 1, F.col("_b"))
    return rows.select("link_id", other.alias("alternate"))


def totals(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: node and link counts, customers and capacity."""
    parts = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("l"), "customers", F.lit(0.0).alias("capacity")).unionByName(
        links.select(F.lit(0).alias("n"), F.lit(1).alias("l"), F.lit(0).cast("long").alias("customers"),
                     F.col("capacity_gbps").alias("capacity"))
    )
    return parts.agg(
        F.sum("n").alias("total_nodes"), F.sum("l").alias("total_links"),
        F.sum("customers").alias("total_customers"), F.sum("capacity").alias("total_capacity_gbps"),
    )


def link_capacity(rows: DataFrame, links: DataFrame, link: str, default: float = 100.0) -> DataFrame:
    caps = links.select(F.col("link_id").alias(link), F.col("capacity_gbps").alias("_cap"))
    return rows.join(caps, link, "left").withColumn("capacity_gbps", F.coalesce("_cap", F.lit(default))).drop("_cap")


def customer_impact(affected: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Share of all customers behind the distinct nodes of each key. `affected`: key, entity_id (node or link)."""
    ends = F.when(F.col("entity_id").contains("-"), F.slice(F.split("entity_id", "-"), 1, 2)).otherwise(F.array("entity_id"))
    touched = affected.select(key, F.explode(ends).alias("node_id")).distinct()
    total = nodes.agg(F.sum("customers")).scalar()
    hit = touched.join(nodes.select("node_id", "customers"), "node_id", "left").groupBy(key).agg(
        F.coalesce(F.sum("customers"), F.lit(0)).alias("customers")
    )
    share = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("customers") / F.col("total"))).otherwise(0.0)
    return hit.withColumn("total", total).select(key, "customers", share.alias("impact"))


def target_regions(affected: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Regions each key touches, through nodes or link ends."""
    ends = F.when(F.col("entity_id").contains("-"), F.slice(F.split("entity_id", "-"), 1, 2)).otherwise(F.array("entity_id"))
    touched = affected.select(key, F.explode(ends).alias("node_id"))
    return touched.join(nodes.select("node_id", "region"), "node_id").select(key, "region").distinct()


def not_blocked(actions: DataFrame, regions: DataFrame, blocked: list[str], key: str) -> DataFrame:
    """Actions that touch no blocked region."""
    stopped = regions.where(F.col("region").isin(*blocked)).select(key).distinct()
    return actions.join(stopped, key, "left_anti")

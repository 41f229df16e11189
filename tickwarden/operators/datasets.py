"""Labelled datasets: telemetry rows that given scenarios cover, and conversation examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwarden.functions.ids import lookup
from tickwarden.functions.text import OUTCOME_NOTES, chat
from tickwarden.operators.intervals import interval_join
from tickwarden.operators.series import with_position
from tickwarden.operators.topology import incidence
from tickwarden.session import cut


def draw(seed: int, *parts: Column) -> Column:
    """Uniform [0, 1) from a hash: the same for the same key on every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 40)) / float(1 << 40)


# -- coverage ----------------------------------------------------------------------------------------------------

def role_readings(long: DataFrame, scenarios: DataFrame, links: DataFrame) -> DataFrame:
    """The readings, with scenario_id and role, inside the window of each scenario: of its root, and of the links that meet it.

    Links at a root node are `attached`; links that share an end with a root link are its `sibling`s. Scenarios meet readings by
    node and time, so that links of a node without a reading in the window are never listed.
    """
    names = ["scenario_id", "start_time", "end_time"]
    inside = lambda rows, windows, on: interval_join(rows, windows, "start_time", "end_time", on=[on])
    role = lambda rows, name: rows.select(*long.columns, "scenario_id", F.lit(name).alias("role"))
    of_node = scenarios.where(F.col("root_cause_node").isNotNull()).select(*names, F.col("root_cause_node").alias("node_id"))
    of_link = scenarios.where(F.col("root_cause_link").isNotNull() & F.col("root_cause_node").isNull()).select(*names, F.col("root_cause_link").alias("target_link"))
    ends = cut(incidence(links).select(F.col("link_id").alias("entity_id"), "node_id"))
    nodes = cut(ends.groupBy("entity_id").agg(F.array_sort(F.collect_set("node_id")).alias("_nodes")))
    roots = of_node.withColumnRenamed("node_id", "entity_id").unionByName(of_link.withColumnRenamed("target_link", "entity_id"))
    # Links that share both ends with the root meet it at the first of them.
    own = nodes.select(F.col("entity_id").alias("target_link"), F.col("_nodes").alias("_own"))
    own = of_link.join(own, "target_link").withColumn("node_id", F.explode("_own"))
    met = inside(long.join(nodes, "entity_id").withColumn("node_id", F.explode("_nodes")), own, "node_id")
    met = met.where((F.col("entity_id") != F.col("target_link")) & (F.array_min(F.array_intersect("_own", "_nodes")) == F.col("node_id")))
    attached = inside(long.join(ends, "entity_id"), of_node, "node_id")
    return role(inside(long, roots, "entity_id"), "root").unionByName(role(attached, "attached")).unionByName(role(met, "sibling"))


def covered(long: DataFrame, scenarios: DataFrame, links: DataFrame) -> DataFrame:
    """The readings inside each scenario's window of the entities that have a role in it.

    Adds scenario_id, role and `share`, the reading's place among those of its entity and scenario: from 0 for the first
    to 1 for the last one, 0 for a single one.
    """
    hits = role_readings(long, scenarios, links)
    keys = ["scenario_id", "entity_id"]
    placed = with_position(hits, keys, ["ts", "seq", "metric"])
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("_n"))
    share = F.when(F.col("_n") > 1, F.col("pos") / (F.col("_n") - 1)).otherwise(0.0)
    return placed.join(sizes, keys).withColumn("share", share).select(*long.columns, "scenario_id", "role", "share")


# -- conversations -----------------------------------------------------------------------------------------------

def metric_lines(metrics: Column, digits: int = 3, first: int = 12) -> Column:
    """`  name: value` lines of the first metrics of a map."""
    entries = F.slice(F.map_entries(metrics), 1, first)
    return F.array_join(F.transform(entries, lambda e: F.format_string(f"  %s: %.{digits}f", e["key"], e["value"])), "\n")


def conversations(outcomes: DataFrame) -> DataFrame:
    """One example per recorded outcome: messages and metadata. Rows without action or root cause are left out.

    Columns: scenario_type, action_type, outcome, root_cause, description, confidence, pre_metrics.
    """
    rows = outcomes.where((F.col("action_type") != "") & (F.col("root_cause") != ""))
    user = F.format_string(
        "Incident type: %s\nSeen: %s\nSuspected origin: %s (%.2f sure)\nMetrics before any action:\n%s\n\nWhich action do you propose?",
        "scenario_type", "description", "root_cause", "confidence", metric_lines(F.col("pre_metrics")),
    )
    assistant = F.format_string(
        "Proposal: %s\nReason: %s starting at %s is met with %s, %.2f sure.\n%s",
        "action_type", "scenario_type", "root_cause", "action_type", "confidence", lookup(OUTCOME_NOTES, F.col("outcome"), ""),
    )
    metadata = F.create_map(
        F.lit("outcome"), "outcome", F.lit("scenario_type"), "scenario_type", F.lit("action_type"), "action_type"
    )
    return rows.select(chat(user, assistant).alias("messages"), metadata.alias("metadata"))


def add_examples(examples: DataFrame, written: DataFrame) -> DataFrame:
    """Append hand-written (user, assistant) pairs."""
    none = F.lit(None).cast("map<string,string>")
    own = written.select(
        chat(F.col("user"), F.col("assistant")).alias("messages"),
        (F.col("metadata") if "metadata" in written.columns else none).alias("metadata"),
    )
    return examples.unionByName(own)

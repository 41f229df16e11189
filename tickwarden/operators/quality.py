"""Validation rules and cleaning (rows in, rows plus reasons out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwarden.schemas import (
    ACTION_TYPES, LINK_METRICS, LINK_STATUS, METRICS, NODE_METRICS, NODE_STATUS, NODE_TYPES, OUTCOMES,
    PASSIVE_ACTIONS, SEVERITIES,
)

REQUIRED = ("timestamp", "entity_id", "entity_type")


def _holds(test: Column) -> Column:
    return F.coalesce(test, F.lit(True))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add `reasons`, the names of the rules a row breaks. A rule over a null is not broken."""
    broken = F.array_compact(F.array(*[F.when(~_holds(test), F.lit(name)) for name, test in rules.items()]))
    return df.withColumn("reasons", broken)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") == 0).drop("reasons")


def rejects(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") > 0)


def reading_rules(link_id: Column, metrics: Column) -> dict[str, Column]:
    """Rules over a metric map: link id form, percentages in range, nothing negative."""
    def pct(name):
        return F.try_element_at(metrics, F.lit(name)).between(0, 100)
    return {
        "link_id_format": link_id.isNull() | link_id.contains("-"),
        "utilization_range": pct("utilization_pct"),
        "loss_range": pct("packet_loss_pct"),
        "negative_metric": F.forall(F.map_values(metrics), lambda v: v >= 0),
    }


def long_reading_rules(entity: Column, entity_type: Column, metric: Column, value: Column) -> dict[str, Column]:
    """The reading rules over long rows, one metric per row."""
    percent = metric.isin("utilization_pct", "packet_loss_pct")
    return {
        "link_id_format": (entity_type != "link") | entity.contains("-"),
        "pct_range": ~percent | value.between(0, 100),
        "negative_metric": value >= 0,
    }


def node_rules(n: str = "") -> dict[str, Column]:
    c = lambda name: F.col(n + name)
    return {
        "node_type": c("node_type").isin(*NODE_TYPES),
        "cpu_pct": c("cpu_pct").between(0, 100),
        "memory_pct": c("memory_pct").between(0, 100),
        "temperature_c": c("temperature_c").between(-10, 200),
        "buffer_drops": c("buffer_drops") >= 0,
        "status": c("status").isin(*NODE_STATUS),
    }


def link_rules(n: str = "") -> dict[str, Column]:
    c = lambda name: F.col(n + name)
    forward, backward = F.concat_ws("-", c("source"), c("target")), F.concat_ws("-", c("target"), c("source"))
    return {
        "latency_ms": c("latency_ms") >= 0,
        "packet_loss_pct": c("packet_loss_pct").between(0, 100),
        "utilization_pct": c("utilization_pct").between(0, 100),
        "throughput_gbps": c("throughput_gbps") >= 0,
        "capacity_gbps": c("capacity_gbps") > 0,
        "over_capacity": c("throughput_gbps") <= c("capacity_gbps"),
        "link_id_format": c("link_id").contains("-"),
        "link_id_endpoints": (c("link_id") == forward) | (c("link_id") == backward),
        "status": c("status").isin(*LINK_STATUS),
    }


def anomaly_rules() -> dict[str, Column]:
    return {
        "target": F.coalesce("node_id", "link_id").isNotNull(),
        "severity": F.col("severity").isin(*SEVERITIES),
        "confidence": F.col("confidence").between(0, 1),
    }


def action_rules() -> dict[str, Column]:
    passive = F.col("action_type").isin(*PASSIVE_ACTIONS)
    return {
        "action_type": F.col("action_type").isin(*ACTION_TYPES),
        "target": passive | F.coalesce("target_node", "target_link").isNotNull(),
        "risk_level": F.col("risk_level").between(0, 1),
    }


def result_rules() -> dict[str, Column]:
    return {
        "rollback_token": ~F.col("rollback_available") | F.col("rollback_token").isNotNull(),
        "outcome": F.col("outcome").isin(*OUTCOMES),
    }


def missing_columns(df: DataFrame, required=REQUIRED) -> list[str]:
    return sorted(set(required) - set(df.columns))


def check_baseline(df: DataFrame) -> DataFrame:
    """Refuse a training table that lacks a key column, has no metric column or has no rows."""
    missing = missing_columns(df)
    if missing:
        raise ValueError("baseline is missing columns: " + ", ".join(missing))
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    if not any(name in METRICS and kind in numeric for name, kind in df.dtypes):
        raise ValueError("baseline has no numeric metric column")
    if df.isEmpty():
        raise ValueError("baseline is empty")
    return df


def parse_time(text: Column) -> Column:
    """ISO text to a UTC instant: trailing Z and naive text are both UTC; bad text is null."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"[zZ]$", "+00:00"))


def to_number(text: Column) -> Column:
    return text.try_cast("double")


def sanitize(snapshots: DataFrame) -> DataFrame:
    """Nested snapshots to long rows: known metrics with a value only; snapshots without a time are dropped."""
    def side(column, kind, metrics):
        rows = snapshots.select(parse_time(F.col("timestamp")).alias("ts"), F.explode(column).alias("entity_id", "m"))
        rows = rows.select("ts", "entity_id", F.lit(kind).alias("entity_type"), F.explode("m").alias("metric", "value"))
        return rows.where(F.col("metric").isin(*metrics))
    rows = side("nodes", "node", NODE_METRICS).unionByName(side("links", "link", LINK_METRICS))
    return rows.where(F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))

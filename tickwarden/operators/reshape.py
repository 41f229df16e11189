"""Wide, long, nested and windowed shapes of telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwarden.functions.ids import variable
from tickwarden.operators.series import first_per_key, over_series
from tickwarden.schemas import LINK_METRICS, METRICS, NODE_METRICS


def to_long(wide: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per (time, entity, metric); an entity keeps only the metrics of its own type."""
    present = [m for m in metrics if m in wide.columns]
    rows = wide.select("timestamp", "entity_id", "entity_type", *[F.col(m).cast("double") for m in present])
    rows = rows.unpivot(["timestamp", "entity_id", "entity_type"], present, "metric", "value")
    own = (F.col("entity_type") == "node") & F.col("metric").isin(*NODE_METRICS)
    own = own | ((F.col("entity_type") == "link") & F.col("metric").isin(*LINK_METRICS))
    return rows.where(own & F.col("value").isNotNull() & ~F.isnan("value")).withColumnRenamed("timestamp", "ts")


def distinct_readings(long: DataFrame) -> DataFrame:
    """First reading per (time, entity, metric)."""
    return first_per_key(long, ["ts", "entity_id", "metric"], ["seq"])


def to_snapshots(long: DataFrame, shards: int = 1) -> DataFrame:
    """Nested document per time. `shards` splits one tick's document by entity when a network is very large."""
    shard = F.pmod(F.xxhash64("entity_id"), F.lit(shards)).cast("int")
    readings = long.groupBy("ts", "entity_id", "entity_type", "metric").agg(F.min_by("value", "seq").alias("value"))
    entities = readings.groupBy("ts", "entity_id", "entity_type").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics")
    )
    def members(kind):
        entry = F.when(F.col("entity_type") == kind, F.struct("entity_id", "metrics"))
        return F.map_from_entries(F.collect_list(entry)).alias(kind + "s")
    return entities.groupBy("ts", shard.alias("shard")).agg(members("node"), members("link"))


def flatten_snapshots(nested: DataFrame, *keep: str) -> DataFrame:
    """Nested state back to long rows."""
    def side(column, kind):
        rows = nested.select(*keep, F.explode(column).alias("entity_id", "_m"), F.lit(kind).alias("entity_type"))
        return rows.select(*keep, "entity_id", "entity_type", F.explode("_m").alias("metric", "value"))
    return side("nodes", "node").unionByName(side("links", "link"))


def metric_matrix(long: DataFrame, names: Sequence[str], time: str = "ts") -> DataFrame:
    """Time x variable matrix for a short, named list of variables; first reading wins."""
    rows = long.withColumn("variable", variable(F.col("entity_id"), F.col("metric")))
    return rows.groupBy(time).pivot("variable", list(names)).agg(F.min_by("value", "seq"))


def gap_fill(grid: DataFrame, keys: Sequence[str], tick: str, value: str, first: int, last: int) -> DataFrame:
    """Fill every tick in [first, last] forward from the last value, and before the first value from it.

    Each known row emits the ticks up to the next known row, so work follows the output, not the longest series.
    """
    known = grid.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, tick, value)
    spans = over_series(
        known, keys, [tick],
        lambda w: {"_next": F.lead(tick).over(w), "_prev": F.lag(tick).over(w)}, before=1, after=1,
    )
    start = F.when(F.col("_prev").isNull(), F.lit(first)).otherwise(F.col(tick))
    stop = F.when(F.col("_next").isNull(), F.lit(last)).otherwise(F.col("_next") - 1)
    kind = known.schema[tick].dataType
    spans = spans.withColumns({"_from": start.cast(kind), "_to": stop.cast(kind)}).where(F.col("_from") <= F.col("_to"))
    filled = spans.select(
        *keys, F.col(tick).alias("_known"), F.explode(F.sequence("_from", "_to")).alias(tick), value
    )
    return filled.withColumn("filled", F.col(tick) != F.col("_known")).drop("_known")


def chart_series(long: DataFrame, metric: str, entities: Sequence[str], time: str = "ts") -> DataFrame:
    """Time x chosen entities for one metric."""
    rows = long.where((F.col("metric") == metric) & F.col("entity_id").isin(*entities))
    return rows.groupBy(time).pivot("entity_id", list(entities)).agg(F.min_by("value", "seq"))


def first_entities(long: DataFrame, kind: str, n: int = 3) -> DataFrame:
    """The first `n` entity ids of a kind."""
    return long.where(F.col("entity_type") == kind).select("entity_id").distinct().orderBy("entity_id").limit(n)


def capture_metrics(state: DataFrame, affected: DataFrame, key: str) -> DataFrame:
    """Per `key`, the metrics of its affected entities as an `entity.metric -> value` map."""
    rows = affected.select(key, "entity_id").distinct().join(state, "entity_id")
    entry = F.struct(F.concat_ws(".", "entity_id", "metric"), F.col("value"))
    return rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metrics"))


def recapture_metrics(captured: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Values now, for the keys captured before."""
    wanted = captured.select(key, F.explode(F.map_keys("metrics")).alias("_k"))
    name = F.split(F.col("_k"), r"\.", 2)
    wanted = wanted.select(key, "_k", name[0].alias("entity_id"), name[1].alias("metric"))
    rows = wanted.join(state.select("entity_id", "metric", "value"), ["entity_id", "metric"])
    return rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "value")))).alias("metrics"))


def outcome_features(results: DataFrame, names: Sequence[str]) -> DataFrame:
    """One feature row per outcome: `pre_*` values for a named list of keys, class, action, confidence, label."""
    values = [F.try_element_at("pre_metrics", F.lit(n)).alias("pre_" + n.replace(".", "_")) for n in names]
    return results.select(
        *values, F.col("scenario_type").alias("anomaly_type"), "action_type",
        F.col("confidence").alias("hypothesis_confidence"), "outcome",
    )


def observation_vector(state: DataFrame, key: str) -> DataFrame:
    """Per snapshot, links in id order with scaled (utilisation, latency, loss, throughput) flattened."""
    def scaled(metric, unit):
        return F.coalesce(F.max(F.when(F.col("metric") == metric, F.col("value"))), F.lit(0.0)) / unit
    links = state.groupBy(key, "entity_id").agg(
        F.array(
            scaled("utilization_pct", 100.0), scaled("latency_ms", 100.0),
            scaled("packet_loss_pct", 5.0), scaled("throughput_gbps", 400.0),
        ).alias("_v")
    )
    rows = F.array_sort(F.collect_list(F.struct("entity_id", "_v")))
    return links.groupBy(key).agg(F.flatten(F.transform(rows, lambda r: r["_v"])).alias("observation"))


def history(long: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 60) -> DataFrame:
    """Each row with its last `n` values, oldest first."""
    return over_series(
        long, keys, order,
        lambda w: {"history": F.collect_list("value").over(w.rowsBetween(-(n - 1), Window.currentRow))}, before=n - 1,
    )


def training_windows(
    long: DataFrame, keys: Sequence[str], order: Sequence[str], lags: int = 30, ahead: int = 10, value: str = "value"
) -> DataFrame:
    """Sliding (x = `lags` values, y = next `ahead` values); incomplete windows are left out. Keyed by the last x row."""
    framed = over_series(
        long, keys, order,
        lambda w: {
            "x": F.collect_list(value).over(w.rowsBetween(-(lags - 1), 0)),
            "y": F.collect_list(value).over(w.rowsBetween(1, ahead)),
        },
        before=lags - 1, after=ahead,
    )
    return framed.where((F.size("x") == lags) & (F.size("y") == ahead))


def minmax_scale(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Scale to [0, 1] per key and keep `lo` and `span`; a constant series scales to 0."""
    bounds = long.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    span = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    rows = long.join(bounds.withColumn("span", span).drop("hi"), list(keys))
    return rows.withColumn("scaled", (F.col(value) - F.col("lo")) / F.col("span"))


def minmax_restore(scaled, lo, span):
    return scaled * span + lo


def split_at(rows: DataFrame, time: str, cutoff) -> DataFrame:
    """Chronological split: rows before the cutoff train, the rest test."""
    return rows.withColumn("split", F.when(F.col(time) < F.lit(cutoff), "train").otherwise("test"))


def node_features(readings: DataFrame, nodes: DataFrame, ticks: DataFrame, metrics: Sequence[str], time: str) -> DataFrame:
    """Dense (tick, node) feature rows for the nodes seen in a tick's snapshot, missing metrics 0, with pseudo-labels."""
    value = lambda m: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0))
    rows = readings.join(ticks, time, "left_semi") if ticks is not None else readings
    rows = rows.join(nodes.select(F.col("node_id").alias("entity_id")), "entity_id", "left_semi")
    features = rows.groupBy(time, "entity_id").agg(*[value(m).alias(m) for m in metrics])
    rule = F.lit(False)
    for name, limit in (("cpu_pct", 85.0), ("memory_pct", 80.0), ("temperature_c", 70.0), ("buffer_drops", 100.0)):
        if name in metrics:
            rule = rule | (F.col(name) > limit)
    return features.withColumn("label", rule.cast("int"))

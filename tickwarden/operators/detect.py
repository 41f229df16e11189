"""Detectors and how their outputs combine.

A detector is any callable `long telemetry -> anomaly rows` with the ANOMALIES columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwarden.functions.ids import lookup
from tickwarden.functions.severity import (
    observed_severity, report_confidence, report_value, severity_rank, sigma_severity,
)
from tickwarden.operators.scan import ewma_before
from tickwarden.operators.series import CHUNK_ROWS, MAX_SERIES_ROWS, chunked, hottest, with_position
from tickwarden.schemas import DEFAULT_LATENCY_MS, LATENCY_FACTOR, THRESHOLDS

Detector = Callable[[DataFrame], DataFrame]
SERIES = ["entity_id", "metric"]
ORDER = ["ts", "seq"]


def anomaly(
    rows: DataFrame, observed: Column, expected: Column, severity: Column, confidence: Column, detector: str
) -> DataFrame:
    return rows.select(
        "ts", "entity_id", "metric",
        report_value(observed).alias("observed"),
        report_value(expected).alias("expected"),
        severity.alias("severity"),
        report_confidence(confidence).alias("confidence"),
        F.lit(detector).alias("detector"),
        "seq",
    )


def latency_baselines(links: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """Latency baseline per link: the measured baseline where there is one, else the topology's."""
    base = links.select(F.col("link_id").alias("entity_id"), F.col("latency_baseline_ms").alias("topology_ms"))
    if baselines is None:
        return base.withColumnRenamed("topology_ms", "baseline_ms")
    measured = baselines.where(F.col("metric") == "latency_ms").select("entity_id", F.col("baseline").alias("measured_ms"))
    merged = base.join(measured, "entity_id", "full_outer")
    return merged.select("entity_id", F.coalesce("measured_ms", "topology_ms").alias("baseline_ms"))


def with_limit(long: DataFrame, thresholds: dict | None = None, latency: DataFrame | None = None) -> DataFrame:
    """Add `limit`. Only latency rows need the baseline table, so only they are joined."""
    merged = {**THRESHOLDS, **(thresholds or {})}
    factor = merged.pop("latency_ms_factor", LATENCY_FACTOR)
    fixed = lookup({k: v for k, v in merged.items() if not math.isinf(v)}, F.col("metric"))
    if latency is None:
        baseline = F.lit(DEFAULT_LATENCY_MS)
        rows = long
    else:
        rows = long.join(latency.select("entity_id", "baseline_ms"), "entity_id", "left")
        baseline = F.coalesce("baseline_ms", F.lit(DEFAULT_LATENCY_MS))
    limit = F.when(F.col("metric") == "latency_ms", baseline * factor).otherwise(fixed)
    return rows.withColumn("limit", limit).drop("baseline_ms")


def threshold(thresholds: dict | None = None, latency: DataFrame | None = None) -> Detector:
    """Strictly above the limit. Metrics without a finite limit never fire."""
    def detect(long: DataFrame) -> DataFrame:
        rows = with_limit(long, thresholds, latency).where(F.col("value") > F.col("limit"))
        ratio = F.col("value") / F.col("limit")
        return anomaly(rows, F.col("value"), F.col("limit"), observed_severity(ratio), F.lit(0.7), "threshold")
    return detect


def halo_rows(alpha: float) -> int:
    """Rows after which a forgotten start weighs under 1e-30: once for the mean, once more for the variance."""
    return 2 * math.ceil(math.log(1e-30) / math.log1p(-alpha))


def _ewma_step(alpha: float):
    """Averages of rows sorted by (series, chunk, position); the last series of a batch goes on in the next one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, n, mean, var = None, 0, 0.0, 0.0
        for pdf in batches:
            if pdf.empty:
                continue
            keys, start = pdf["_key"].to_numpy(), pdf["_start"].to_numpy()
            new = np.ones(len(keys), dtype=bool)
            new[1:] = keys[1:] != keys[:-1]
            goes_on = keys[0] == current
            firsts = np.flatnonzero(new)
            begin = np.where(np.arange(len(firsts)) == 0, n, start[firsts]) if goes_on else start[firsts]
            new[0] = not goes_on
            means, variances, (mean, var) = ewma_before(pdf["value"].to_numpy(dtype=float), new, alpha, mean, var)
            of = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(keys))))
            pdf["n_before"] = begin[of] + np.arange(len(keys)) - firsts[of]
            pdf["mean_before"], pdf["var_before"] = means, variances
            current, n = keys[-1], int(pdf["n_before"].iloc[-1]) + 1
            yield pdf.drop(columns=["_key", "_start"])

    return run


def ewma(
    long: DataFrame, span: int = 20, keys: Sequence[str] = SERIES, order: Sequence[str] = ORDER,
    max_rows: int = MAX_SERIES_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Each row with the exponentially weighted count, mean and variance of its series *before* that row.

    Short series run whole. A series above `max_rows` is cut into chunks of positions that each replay enough
    earlier rows for the start value to have decayed below 1e-30, so chunks run in parallel and agree with the
    full recurrence to double precision.
    """
    alpha = 2.0 / (span + 1)
    size = hottest(long, keys)
    if size <= max_rows:
        rows = long.withColumns({"_start": F.lit(0).cast("long"), "halo": F.lit(False)})
        placed = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
        sort_key = F.concat_ws("\u0001", *keys)
    else:
        halo = halo_rows(alpha)
        rows = chunked(with_position(long, keys, order, max_rows, size), halo, 0, max(chunk_rows, halo))
        first = F.greatest(F.col("chunk") * max(chunk_rows, halo) - halo, F.lit(0))
        rows = rows.withColumn("_start", first)
        placed = rows.repartition(*keys, "chunk").sortWithinPartitions(*keys, "chunk", "pos")
        sort_key = F.concat_ws("\u0001", *keys, F.col("chunk").cast("string"))
    fields = [f"`{c}` {t}" for c, t in long.dtypes] + ["halo boolean"]
    schema = ", ".join(fields + ["n_before bigint", "mean_before double", "var_before double"])
    feed = placed.withColumn("_key", sort_key).select(*long.columns, "halo", "_key", "_start")
    return feed.mapInPandas(_ewma_step(alpha), schema).where(~F.col("halo")).drop("halo")


def ewma_end_state(scored: DataFrame, span: int = 20, keys: Sequence[str] = SERIES) -> DataFrame:
    """Count, mean and variance per series after its last row; what a later run or a stream starts from."""
    alpha = 2.0 / (span + 1)
    diff = F.col("value") - F.col("mean_before")
    first = F.col("n_before") == 0
    after = F.struct(
        (F.col("n_before") + 1).alias("n"),
        F.when(first, F.col("value")).otherwise(F.col("mean_before") + alpha * diff).alias("mean"),
        F.when(first, F.lit(0.0)).otherwise((1 - alpha) * (F.col("var_before") + alpha * diff * diff)).alias("variance"),
    )
    return scored.groupBy(*keys).agg(F.max_by(after, F.col("n_before")).alias("_s")).select(*keys, "_s.*")


def ewma_hits(scored: DataFrame, span: int = 20) -> DataFrame:
    """Anomaly rows of a scored table: warm, not flat, and at least three sigmas away."""
    std = F.sqrt(F.greatest("var_before", F.lit(0.0)))
    rows = scored.withColumn("std", std).where((F.col("n_before") >= span // 2) & (F.col("std") >= 1e-6))
    rows = rows.withColumn("sigmas", F.abs(F.col("value") - F.col("mean_before")) / F.col("std"))
    rows = rows.where(F.col("sigmas") >= 3.0)
    confidence = F.least(F.lit(0.95), F.col("sigmas") / 3.0 * 0.7)
    return anomaly(rows, F.col("value"), F.col("mean_before"), sigma_severity(F.col("sigmas")), confidence, "ewma")


def ewma_detector(span: int = 20, **limits) -> Detector:
    return lambda long: ewma_hits(ewma(long, span, **limits), span)


def ensemble(detections: DataFrame, boost: float = 0.15) -> DataFrame:
    """One row per (time, entity, metric): the most confident detection, raised when two or more agree.

    Equal confidence goes to the detector that comes first in `detector_order`.
    """
    order = {"threshold": 0, "ewma": 1, "isolation_forest": 2, "graph": 3}
    first = F.coalesce(lookup(order, F.col("detector")), F.lit(9))
    best = F.max_by(
        F.struct("observed", "expected", "severity", "confidence", "detector"), F.struct("confidence", -first)
    )
    grouped = detections.groupBy("ts", "entity_id", "metric", "seq").agg(best.alias("b"), F.count("*").alias("votes"))
    raised = F.round(F.least(F.lit(0.99), F.col("b.confidence") + boost), 4)
    return grouped.select(
        "ts", "entity_id", "metric", "b.observed", "b.expected", "b.severity",
        F.when(F.col("votes") >= 2, raised).otherwise(F.col("b.confidence")).alias("confidence"),
        "b.detector", "seq", "votes",
    )


def run_ensemble(long: DataFrame, detectors: Sequence[Detector], boost: float = 0.15) -> DataFrame:
    return ensemble(reduce(DataFrame.unionByName, [d(long) for d in detectors]), boost)


def by_severity(anomalies: DataFrame) -> DataFrame:
    return anomalies.orderBy(severity_rank(F.col("severity")).desc(), F.col("confidence").desc(), "entity_id", "metric")


def cycle_peaks(anomalies: DataFrame) -> DataFrame:
    """One anomaly per (cycle, entity, metric): the stronger one, later rows on ties."""
    rank = severity_rank(F.col("severity"))
    row = F.max_by(
        F.struct("observed", "expected", "severity", "confidence", "detector", "seq"),
        F.struct(rank, F.col("confidence"), F.col("seq")),
    )
    return anomalies.groupBy("cycle", "entity_id", "metric").agg(row.alias("b")).select("cycle", "entity_id", "metric", "b.*")


def merge_predicted(observed: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed beats predicted on the same key; among observed the stronger one stays, ties to the later."""
    rows = observed.withColumn("priority", F.lit(1)).unionByName(predicted.withColumn("priority", F.lit(0)))
    rank = severity_rank(F.col("severity"))
    others = [c for c in observed.columns if c not in keys]
    row = F.max_by(F.struct(*others), F.struct(F.col("priority"), rank, F.col("confidence"), F.col("seq")))
    return rows.groupBy(*keys).agg(row.alias("_r")).select(*keys, "_r.*")


def emit_changes(cycles: DataFrame, min_delta: float = 0.05) -> DataFrame:
    """New, or changed in severity, or moved in confidence since the cycle before. A skipped cycle means new.

    Cycles hold one row per (cycle, key), so a key's window is as long as the clock has ticks, whatever the data.
    """
    w = Window.partitionBy("entity_id", "metric").orderBy("cycle")
    follows = F.lag("cycle").over(w) == F.col("cycle") - 1
    moved = F.round(F.abs(F.col("confidence") - F.lag("confidence").over(w)), 6) >= min_delta
    state = (
        F.when(F.coalesce(~follows, F.lit(True)), "new")
        .when((F.col("severity") != F.lag("severity").over(w)) | moved, "changed")
        .otherwise("unchanged")
    )
    return cycles.withColumn("change", state)


def resolved(cycles: DataFrame) -> DataFrame:
    """Keys that were active in a cycle and are absent from the next one, at the cycle they end in.

    Keys of the newest cycle are still open.
    """
    w = Window.partitionBy("entity_id", "metric").orderBy("cycle")
    newest = cycles.agg(F.max("cycle")).scalar()
    stays = F.lead("cycle").over(w) == F.col("cycle") + 1
    gone = cycles.withColumn("_stays", F.coalesce(stays, F.lit(False))).where(~F.col("_stays") & (F.col("cycle") < newest))
    return gone.drop("_stays").withColumn("cycle", F.col("cycle") + 1)


def health_summary(active: DataFrame, *keys: str) -> DataFrame:
    """Counts by severity, worst entity and overall state, per key (or once)."""
    count = lambda level: F.count_if(F.col("severity") == level).alias(level)
    worst = F.max_by(
        F.col("entity_id"), F.struct(severity_rank(F.col("severity")), F.col("confidence"), F.col("entity_id"))
    )
    sums = active.groupBy(*keys).agg(
        F.count("*").alias("total_anomalies"), *[count(s) for s in ("low", "medium", "high", "critical")],
        worst.alias("worst_entity"),
    )
    state = (
        F.when(F.col("critical") > 0, "critical")
        .when((F.col("high") > 0) | (F.col("medium") > 0) | (F.col("total_anomalies") >= 3), "degraded")
        .otherwise("healthy")
    )
    return sums.withColumn("overall_health", state)


def severity_share(summary: DataFrame) -> DataFrame:
    total = F.greatest(F.col("total_anomalies"), F.lit(1))
    share = lambda level: F.least(100.0 * F.col(level) / total, F.lit(100.0)).alias(level + "_pct")
    return summary.select("*", share("critical"), share("high"), share("medium"))


def worst_entities(state: DataFrame, *keys: str) -> DataFrame:
    """Worst link by utilisation, worst node by cpu, and how many of each there are."""
    def worst(metric, name):
        hit = F.col("metric") == metric
        order = F.when(hit, F.struct(F.col("value"), F.col("entity_id")))
        return [
            F.max_by(F.when(hit, F.col("entity_id")), order).alias(name),
            F.round(F.max(F.when(hit, F.col("value"))), 4).alias(f"{name}_{metric}"),
        ]
    count = lambda kind: F.count_distinct(F.when(F.col("entity_type") == kind, F.col("entity_id")))
    return state.groupBy(*keys).agg(
        *worst("utilization_pct", "worst_link"), *worst("cpu_pct", "worst_node"),
        count("node").alias("total_nodes"), count("link").alias("total_links"),
    )


def most_severe(anomalies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most severe anomaly per key; the first one wins a tie."""
    others = [c for c in anomalies.columns if c not in keys]
    order = F.struct(severity_rank(F.col("severity")), -F.unix_micros("ts"), -F.col("seq"))
    return anomalies.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def describe_series(long: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return long.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean")
    )


def baselines(long: DataFrame) -> DataFrame:
    """Mean per (entity, metric) over finite values."""
    return long.where(~F.isnan("value")).groupBy("entity_id", "metric").agg(F.avg("value").alias("baseline"))


def first_baselines(long: DataFrame) -> DataFrame:
    """Baseline from the first reading of each series."""
    return long.groupBy("entity_id", "metric").agg(F.min_by("value", F.struct("ts", "seq")).alias("baseline"))

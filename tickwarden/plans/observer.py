"""The observe cycle over tables: fit on a baseline, detect, forecast, merge, report what is new."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.functions.ids import lookup
from tickwarden.operators import detect as D
from tickwarden.operators import forecast as FC
from tickwarden.operators import forest as IF
from tickwarden.operators.reshape import history
from tickwarden.schemas import FORECAST_LIMITS
from tickwarden.session import cut


@dataclass
class ObserverModel:
    """Everything the detectors learned, as tables. `start` is what a stream's series go on from."""

    baselines: DataFrame
    latency: DataFrame
    ewma_state: DataFrame
    forest_steps: DataFrame
    forest_offsets: DataFrame
    start: DataFrame


def fit(baseline: DataFrame, links: DataFrame, span: int = 20, trees: int = 100, seed: int = 42) -> ObserverModel:
    """Train on a baseline of long telemetry."""
    means = D.baselines(baseline)
    steps = cut(IF.fit_forest(baseline, trees, seed))
    offsets = cut(IF.forest_offsets(IF.score_forest(baseline, steps)))
    state = D.ewma_end_state(D.ewma(baseline, span), span)
    recent = FC.recent_values(baseline).select("entity_id", "metric", "values")
    return ObserverModel(
        baselines=means,
        latency=D.latency_baselines(links, means),
        ewma_state=state,
        forest_steps=steps,
        forest_offsets=offsets,
        start=state.join(recent, ["entity_id", "metric"]).select("entity_id", "metric", "n", "mean", "variance", "values"),
    )


def rolling_predictions(long: DataFrame, limits: dict | None = None, n: int = 60) -> DataFrame:
    """Predicted anomalies at every reading, each from the 60 readings up to it."""
    watched = long.where(F.col("metric").isin(*(FORECAST_LIMITS if limits is None else limits)))
    return predictions(history(watched, D.SERIES, D.ORDER, n), limits)


def predictions(rows: DataFrame, limits: dict | None = None) -> DataFrame:
    """Predicted anomalies of readings that carry their `history`."""
    limits = FORECAST_LIMITS if limits is None else limits
    rows = rows.where(F.col("metric").isin(*limits)).withColumn("limit", lookup(limits, F.col("metric")))
    rows = rows.withColumns({"level": FC.level(F.col("history")), "slope": FC.slope(F.col("history"))}).drop("history")
    rows = rows.withColumn("predictions", FC.extend(F.col("level"), F.col("slope")))
    return FC.predicted_anomalies(FC.summarise(rows, fallback=True))


def observe(
    baseline: DataFrame, long: DataFrame, model: ObserverModel, span: int = 20, period_seconds: int = 60,
    graph: DataFrame | None = None,
) -> DataFrame:
    """All cycles of `long` at once: one row per (cycle, entity, metric) with `change` new, changed or unchanged.

    The moving averages continue from the baseline. `graph` adds anomaly rows of a graph score.
    """
    start = long.agg(F.min("ts")).scalar()
    tagged = baseline.withColumn("_warm", F.lit(True)).unionByName(long.withColumn("_warm", F.lit(False)))
    moving = D.ewma(tagged, span).where(~F.col("_warm"))
    predicted = rolling_predictions(tagged.drop("_warm")).where(F.col("ts") >= start)
    return D.emit_changes(merge_cycles(long, moving, predicted, model, span, period_seconds, graph))


def detections(
    rows: DataFrame, model: ObserverModel | None, span: int = 20, period_seconds: int = 60, predict: bool = True, graph: DataFrame | None = None,
) -> DataFrame:
    """One anomaly per (cycle, entity, metric) of readings that carry their moving average and their history."""
    predicted = predictions(rows) if predict else None
    return merge_cycles(rows, rows, predicted, model, span, period_seconds, graph)


def merge_cycles(
    long: DataFrame, moving: DataFrame, predicted: DataFrame | None, model: ObserverModel | None, span: int, period_seconds: int, graph: DataFrame | None,
) -> DataFrame:
    """Ensemble of all detectors, per cycle, with predictions where nothing was observed. No model: thresholds and averages only."""
    columns = ["ts", "entity_id", "entity_type", "metric", "value", "seq"]
    long = long.select(*columns)
    observed = D.threshold(latency=None if model is None else model.latency)(long).unionByName(D.ewma_hits(moving, span))
    if model is not None:
        observed = observed.unionByName(IF.forest_detector(model.forest_steps, model.forest_offsets)(long))
    observed = D.ensemble(observed).drop("votes")
    if graph is not None:
        observed = observed.unionByName(graph.select(observed.columns))
    cycle = F.floor(F.unix_seconds("ts") / period_seconds)
    peaks = D.cycle_peaks(observed.withColumn("cycle", cycle))
    if predicted is None:
        return peaks
    names = ["cycle", "entity_id", "metric", "observed", "expected", "severity", "confidence", "detector", "seq"]
    return D.merge_predicted(peaks, D.cycle_peaks(predicted.withColumn("cycle", cycle)).select(*names), ["cycle", "entity_id", "metric"])


def emitted(cycles: DataFrame, period_seconds: int = 60) -> DataFrame:
    """New and changed anomalies with the time of their cycle."""
    return cycles.where(F.col("change") != "unchanged").withColumn("ts", F.timestamp_seconds(F.col("cycle") * period_seconds))



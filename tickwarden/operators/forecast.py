"""Short-horizon forecasts: a trend model in column expressions and a learned linear model."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwarden.functions.ids import lookup
from tickwarden.functions.severity import clamp, predicted_severity
from tickwarden.operators.detect import ORDER, SERIES
from tickwarden.operators.reshape import minmax_scale, training_windows
from tickwarden.operators.series import last_rows
from tickwarden.schemas import FORECAST_LIMITS

HORIZON = 10


def recent_values(long: DataFrame, n: int = 60, keys: Sequence[str] = SERIES, order: Sequence[str] = ORDER) -> DataFrame:
    """Last `n` values per series, oldest first, with the time of the newest. Groups hold at most `n` rows."""
    tail = last_rows(long, keys, order, n)
    rows = F.array_sort(F.collect_list(F.struct(*order, "value")))
    return tail.groupBy(*keys).agg(rows.alias("_r")).select(
        *keys, F.transform("_r", lambda r: r["value"]).alias("values"),
        F.element_at("_r", -1)["ts"].alias("ts"), F.element_at("_r", -1)["seq"].alias("seq"),
    )


def level(values: Column, span: int = 10) -> Column:
    alpha = 2.0 / (span + 1)
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(values, 1), lambda acc, x: acc + (x - acc) * alpha)


def slope(values: Column, points: int = 10, limit: float = 2.0) -> Column:
    """Least-squares slope of the last `points` values against their index; 0 for a single value."""
    tail = F.slice(values, F.greatest(F.size(values) - points + 1, F.lit(1)), F.lit(points))
    n = F.size(tail).cast("double")
    zero = F.lit(0.0)
    sum_y = F.aggregate(tail, zero, lambda a, y: a + y)
    sum_iy = F.aggregate(F.transform(tail, lambda y, i: y * i), zero, lambda a, y: a + y)
    mean_i = (n - 1) / 2
    spread = n * (n * n - 1) / 12
    return F.when(n >= 2, clamp((sum_iy - mean_i * sum_y) / spread, -limit, limit)).otherwise(0.0)


def extend(start: Column, step: Column, horizon: int = HORIZON) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: start + step * i)


def first_crossing(predictions: Column, limit: Column) -> Column:
    minutes = F.transform(predictions, lambda v, i: F.when(v >= limit, i + 1))
    return F.try_element_at(F.array_compact(minutes), F.lit(1))


def confidence(predictions: Column, limit: Column, peak: Column, minutes: Column, fallback: bool = True) -> Column:
    n = F.size(predictions).cast("double")
    mean = F.aggregate(predictions, F.lit(0.0), lambda a, v: a + v) / n
    var = F.aggregate(predictions, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    margin = F.greatest(F.lit(0.0), (peak - limit) / F.greatest(limit, F.lit(1.0)))
    stability = F.greatest(F.lit(0.0), 1.0 - F.least(F.sqrt(var) / 15.0, F.lit(1.0)))
    urgency = F.when(minutes <= 3, 1.0).when(minutes <= 6, 0.75).otherwise(0.5)
    score = 0.45 + F.least(margin, F.lit(0.5)) * 0.5 + stability * 0.25 + urgency * 0.2 - (0.15 if fallback else 0.0)
    return F.round(clamp(score, 0.0, 0.95), 4)


def summarise(rows: DataFrame, fallback: bool) -> DataFrame:
    """Add peak, first crossing and confidence to rows with `predictions` and `limit`."""
    rows = rows.withColumn("predictions", F.transform("predictions", lambda v: F.round(v, 4)))
    rows = rows.withColumn("peak", F.array_max("predictions"))
    rows = rows.withColumn("minutes_until", first_crossing(F.col("predictions"), F.col("limit")))
    score = confidence(
        F.col("predictions"), F.col("limit"), F.col("peak"), F.coalesce("minutes_until", F.lit(HORIZON)), fallback
    )
    return rows.withColumn("will_congest", F.col("minutes_until").isNotNull()).withColumn("confidence", score)


def forecast_trend(long: DataFrame, limits: dict | None = None, n: int = 60, horizon: int = HORIZON) -> DataFrame:
    """Level plus slope per watched series at its newest reading."""
    limits = FORECAST_LIMITS if limits is None else limits
    watched = long.where(F.col("metric").isin(*limits))
    rows = recent_values(watched, n).withColumns(
        {"level": level(F.col("values")), "slope": slope(F.col("values")), "limit": lookup(limits, F.col("metric"))}
    )
    rows = rows.withColumn("predictions", extend(F.col("level"), F.col("slope"), horizon))
    return summarise(rows, fallback=True)


def predicted_anomalies(forecasts: DataFrame) -> DataFrame:
    """Anomaly rows for forecasts that cross their limit."""
    return forecasts.where("will_congest").select(
        "ts", "entity_id", "metric", F.round("peak", 6).alias("observed"), F.col("limit").alias("expected"),
        predicted_severity(F.col("peak") / F.col("limit")).alias("severity"), "confidence",
        F.lit("forecast_predicted").alias("detector"), "seq",
    )


def _normal_sums(lags: int, ahead: int, samples: int, seed: int):
    """Per task: X'X and X'y of each bootstrap sample, so only (lags+1) x (lags+1+ahead) numbers leave it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = lags + 1
        totals = np.zeros((samples, width, width + ahead))
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy())])
            z = np.column_stack([x, np.stack(pdf["y"].to_numpy())])
            weights = np.stack(pdf["_w"].to_numpy())
            for b in range(samples):
                totals[b] += (x * weights[:, b : b + 1]).T @ z
        index = np.arange(totals[0].size)
        for b in range(samples):
            yield pd.DataFrame({"sample": b, "cell": index, "total": totals[b].ravel()})

    return run


def fit_linear(
    long: DataFrame, keys: Sequence[str] = SERIES, order: Sequence[str] = ORDER, lags: int = 30, ahead: int = HORIZON,
    samples: int = 5, seed: int = 42, ridge: float = 1e-3,
) -> np.ndarray:
    """Coefficients [sample, lags+1, ahead] of linear forecasts from `lags` scaled values to the next `ahead`.

    All series share a model, each scaled to [0, 1]. Bootstrap weights are Poisson draws from a hash of the row,
    so they do not depend on partitioning. Tasks send sums only; the driver solves systems of size lags+1.
    """
    scaled = minmax_scale(long, keys)
    windows = training_windows(scaled, keys, order, lags, ahead, "scaled")
    # Cumulative Poisson(1) probabilities 0..5.
    cumulative = [0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582]
    def weight(b):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(b), *keys, *order), F.lit(1 << 30)) / float(1 << 30)
        return sum((F.when(u >= c, 1.0).otherwise(0.0) for c in cumulative), F.lit(0.0))
    first = F.lit(1.0)  # sample 0 is the full data
    rows = windows.select("x", "y", F.array(first, *[weight(b) for b in range(1, samples)]).alias("_w"))
    parts = rows.mapInPandas(_normal_sums(lags, ahead, samples, seed), "sample int, cell int, total double")
    sums = parts.groupBy("sample", "cell").agg(F.sum("total").alias("total")).toPandas()
    width = lags + 1
    coefficients = np.zeros((samples, width, ahead))
    for b, part in sums.groupby("sample"):
        full = np.zeros(width * (width + ahead))
        full[part["cell"].to_numpy()] = part["total"].to_numpy()
        full = full.reshape(width, width + ahead)
        coefficients[b] = np.linalg.solve(full[:, :width] + ridge * np.eye(width), full[:, width:])
    return coefficients


def forecast_linear(
    long: DataFrame, coefficients: np.ndarray, limits: dict | None = None, keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Forecast at the newest reading of each series with enough history; spread over samples is the uncertainty."""
    limits = FORECAST_LIMITS if limits is None else limits
    samples, width, ahead = coefficients.shape
    lags = width - 1
    bounds = long.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = recent_values(long, lags, keys, order).where(F.size("values") == lags).join(bounds, list(keys))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            span = (pdf["hi"] - pdf["lo"]).to_numpy()
            span = np.where(span == 0, 1.0, span)[:, None]
            low = pdf["lo"].to_numpy()[:, None]
            x = np.column_stack([np.ones(len(pdf)), (np.stack(pdf["values"].to_numpy()) - low) / span])
            every = np.stack([(x @ c) * span + low for c in coefficients])
            out = pdf[list(keys) + ["ts", "seq"]].copy()
            out["predictions"] = list(every[0])
            out["uncertainty"] = every.std(axis=0).mean(axis=1)
            yield out

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "ts", "seq"]) + ", predictions array<double>, uncertainty double"
    out = rows.mapInPandas(predict, schema).withColumn("limit", F.coalesce(lookup(limits, F.col("metric")), F.lit(85.0)))
    return summarise(out, fallback=False).withColumn("high_uncertainty", F.col("uncertainty") > 0.3)


def series_sums(
    long: DataFrame, keys: Sequence[str] = SERIES, order: Sequence[str] = ORDER, lags: int = 30, ahead: int = HORIZON
) -> DataFrame:
    """Per series its `cells`: the sums z'z over its training windows, z = (1, `lags` scaled values, the next `ahead`).

    Tasks add up the windows of a series before anything is shuffled, cell by cell, so a series of a third of all rows
    leaves no more numbers than others. Series without a whole window have no row.
    """
    names, width = list(keys), 1 + lags + ahead
    windows = training_windows(minmax_scale(long, keys), keys, order, lags, ahead, "scaled")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for key, rows in pdf.groupby(names, dropna=False, sort=False):
                z = np.column_stack([np.ones(len(rows)), np.stack(rows["x"].to_numpy()), np.stack(rows["y"].to_numpy())])
                parts.append(pd.DataFrame({**dict(zip(names, key)), "cell": np.arange(width * width), "total": (z.T @ z).ravel()}))
            if parts:
                yield pd.concat(parts)

    kinds = dict(long.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", cell int, total double"
    totals = windows.select(*names, "x", "y").mapInPandas(add, schema).groupBy(*names, "cell").agg(F.sum("total").alias("total"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("cell", "total"))), lambda c: c["total"])
    return totals.groupBy(*names).agg(cells.alias("cells"))


def forecast_series(
    long: DataFrame, sums: DataFrame, limits: dict | None = None, keys: Sequence[str] = SERIES, order: Sequence[str] = ORDER,
    lags: int = 30, ahead: int = HORIZON, strength: float = 30.0, ridge: float = 1e-3,
) -> DataFrame:
    """Forecast at the newest reading of each series by its own least-squares fit, shrunk towards the fit of all series.

    To the sums of a series, the mean window of all series is added as often as `strength` windows of its own; a series
    without windows follows the common fit. `uncertainty` is the root mean square error of these windows, in units of the
    series' range. Series of fewer than `lags` readings have no row. Only the common sums, one number a cell, reach the
    driver.
    """
    limits = FORECAST_LIMITS if limits is None else limits
    names, width, total = list(keys), 1 + lags, 1 + lags + ahead
    common = np.zeros(total * total)
    for row in sums.select(F.posexplode("cells").alias("cell", "total")).groupBy("cell").agg(F.sum("total").alias("total")).collect():
        common[row["cell"]] = row["total"]
    common = common.reshape(total, total) * (strength / max(common[0], 1.0))
    bounds = long.groupBy(*names).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = recent_values(long, lags, keys, order).where(F.size("values") == lags).join(bounds, names).join(sums, names, "left")

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            own = np.stack([np.zeros(total * total) if c is None else np.asarray(c, dtype=float) for c in pdf["cells"]])
            every = own.reshape(-1, total, total) + common
            a, b, c = every[:, :width, :width], every[:, :width, width:], np.einsum("ijj->ij", every[:, width:, width:])
            fitted = np.linalg.solve(a + ridge * np.eye(width), b)
            error = c - 2 * np.einsum("iwh,iwh->ih", fitted, b) + np.einsum("iwh,iwv,ivh->ih", fitted, a, fitted)
            low, span = pdf["lo"].to_numpy()[:, None], (pdf["hi"] - pdf["lo"]).to_numpy()[:, None]
            span = np.where(span == 0, 1.0, span)
            x = np.column_stack([np.ones(len(pdf)), (np.stack(pdf["values"].to_numpy()) - low) / span])
            out = pdf[[*names, "ts", "seq"]].copy()
            out["windows"] = own[:, 0].round().astype(np.int64)
            out["predictions"] = list(np.einsum("iw,iwh->ih", x, fitted) * span + low)
            out["uncertainty"] = np.sqrt(np.maximum(error, 0) / np.maximum(every[:, :1, 0], 1e-9)).mean(axis=1)
            yield out

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*names, "ts", "seq"]) + ", windows long, predictions array<double>, uncertainty double"
    out = rows.mapInPandas(predict, schema).withColumn("limit", F.coalesce(lookup(limits, F.col("metric")), F.lit(85.0)))
    return summarise(out, fallback=False).withColumn("high_uncertainty", F.col("uncertainty") > 0.3)


def worst_uncertainty(forecasts: DataFrame) -> DataFrame:
    return forecasts.agg(F.coalesce(F.max("uncertainty"), F.lit(0.0)).alias("uncertainty"))

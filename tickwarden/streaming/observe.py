"""The observe cycle on a stream: averages, histories and open anomalies are kept between micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickwarden.operators import detect as D
from tickwarden.operators.scan import ewma_of_series
from tickwarden.plans.observer import ObserverModel, detections
from tickwarden.session import cut
from tickwarden.streaming.processors import SHARES, late, shares

HISTORY = 60
READING = "ts timestamp, entity_id string, entity_type string, metric string, value double, seq bigint"


def closed_readings(
    long: DataFrame, start: DataFrame | None = None, span: int = 20, keep: int = HISTORY, period_seconds: int = 60, n_shares: int = SHARES
) -> DataFrame:
    """Readings of closed cycles with the moving average before them and their last `keep` values.

    `long`: a watermarked stream of telemetry. A cycle is closed once the watermark has reached its end; until then its
    readings wait in the state, so that their order of arrival does not matter. Readings that arrive behind the watermark
    are left out (`mark_late` gives them), repeated ones (same time and sequence) count once. A series' state is its
    count, mean and variance, `keep` values and the readings of open cycles; series are kept and read share by share.

    `start`: (entity_id, metric, n, mean, variance, values) of series that a baseline has already shown; its rows are
    joined to the readings, and count only when a series has no state yet.
    """
    alpha, period = 2.0 / (span + 1), period_seconds * 1000
    # Per series, then the series' values one behind the other, then the waiting readings with their series' number.
    fields = {"n": "i8", "mean": "f8", "variance": "f8", "sizes": "i8", "ring": "f8", "ids": "i8", "at": "i8", "seq": "i8", "value": "f8"}

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        entities, metrics, kinds, *held = state.get if state.exists else ((),) * (3 + len(fields))
        names, kinds = list(zip(entities, metrics)), list(kinds)
        n, mean, var, sizes, ring, ids, at, seq, value = (np.array(v, dtype=t) for v, t in zip(held, fields.values()))
        index = {name: i for i, name in enumerate(names)}
        for rows in () if state.hasTimedOut else batches:
            own = np.fromiter((index.setdefault(k, len(index)) for k in zip(rows["entity_id"], rows["metric"])), np.int64, len(rows))
            unseen = np.flatnonzero(own >= len(names))
            first = rows.iloc[unseen[np.unique(own[unseen], return_index=True)[1]]]
            names += zip(first["entity_id"], first["metric"])
            kinds += first["entity_type"].tolist()
            shown = [np.zeros(0) if pd.isna(c) else np.asarray(v, dtype=float) for c, v in zip(first["n"], first["values"])]
            n = np.concatenate([n, first["n"].fillna(0).to_numpy("i8")])
            mean, var = (np.concatenate([old, first[c].fillna(0.0).to_numpy("f8")]) for old, c in ((mean, "mean"), (var, "variance")))
            sizes, ring = np.concatenate([sizes, np.array([len(v) for v in shown], dtype="i8")]), np.concatenate([ring, *shown])
            us = rows["us"].to_numpy()
            fine = ~late(us, mark)
            ids, at, value = (np.concatenate([old, new[fine]]) for old, new in ((ids, own), (at, us), (value, rows["value"].to_numpy())))
            seq = np.concatenate([seq, rows["seq"].to_numpy()[fine]])
        order = np.lexsort((seq, at, ids))
        ids, at, seq, value = ids[order], at[order], seq[order], value[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (at[1:] != at[:-1]) | (seq[1:] != seq[:-1])
        closed = new & (at // (1000 * period) < mark // period)
        own, x = ids[closed], value[closed]
        # Each series' kept values and its closed readings behind them.
        owner = np.concatenate([np.repeat(np.arange(len(names)), sizes), own])
        by = np.argsort(owner, kind="stable")
        owner, values = owner[by], np.concatenate([ring, x])[by]
        came = np.bincount(own, minlength=len(names))
        ends = np.cumsum(sizes + came)
        if len(x):
            begins, stops = np.ones(len(x), dtype=bool), np.ones(len(x), dtype=bool)
            begins[1:] = stops[:-1] = own[1:] != own[:-1]
            place = np.arange(len(x)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            known = n[own] > 0
            means, spreads, after, spread = ewma_of_series(x, begins & ~known, begins & known, mean[own], var[own], alpha)
            to = ends[own] - came[own] + place + 1
            since = np.maximum(ends[own] - came[own] - sizes[own], to - keep)
            yield pd.DataFrame({
                "us": at[closed], "entity_id": [names[i][0] for i in own], "entity_type": [kinds[i] for i in own], "metric": [names[i][1] for i in own],
                "value": x, "seq": seq[closed], "n_before": n[own] + place, "mean_before": means, "var_before": spreads,
                "history": [values[a:b] for a, b in zip(since, to)],
            })
            mean[own[stops]], var[own[stops]] = after[stops], spread[stops]
        stays = ends[owner] - np.arange(len(owner)) <= keep
        n, ring, sizes = n + came, values[stays], np.bincount(owner[stays], minlength=len(names))
        waits = new & ~closed
        ids, at, seq, value = ids[waits], at[waits], seq[waits], value[waits]
        state.update((
            [name[0] for name in names], [name[1] for name in names], kinds, *(v.tolist() for v in (n, mean, var, sizes, ring, ids, at, seq, value))
        ))
        if len(at):
            end = (int(at.min()) // (1000 * period) + 1) * period
            state.setTimeoutTimestamp(max(end, mark + 1))

    known = "entity_id string, metric string, n bigint, mean double, variance double, values array<double>"
    warm = long.sparkSession.createDataFrame([], known) if start is None else start
    rows = long.join(warm, ["entity_id", "metric"], "left").withColumn("us", F.unix_micros("ts"))
    kept = {"i8": "bigint", "f8": "double"}
    out = shares(rows, ["entity_id", "metric"], n_shares).groupBy("share").applyInPandasWithState(
        step, "us bigint, entity_id string, entity_type string, metric string, value double, seq bigint, n_before bigint, mean_before double, "
        "var_before double, history array<double>",
        "entities array<string>, metrics array<string>, kinds array<string>, " + ", ".join(f"{c} array<{kept[t]}>" for c, t in fields.items()),
        "append", GroupStateTimeout.EventTimeTimeout,
    )
    return out.select(F.timestamp_micros("us").alias("ts"), "entity_id", "entity_type", "metric", "value", "seq", "n_before", "mean_before", "var_before", "history")


def follow(found: DataFrame, active: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(changes, active): what a batch of closed cycles brings, and each series' last anomaly for the next batch.

    A series whose last anomaly lies two cycles behind the newest one can no longer go on and is dropped.
    """
    names = ["cycle", "entity_id", "metric", "observed", "expected", "severity", "confidence", "detector", "seq"]
    rows = found.select(*names).withColumn("_old", F.lit(False))
    if active is not None:
        rows = rows.unionByName(active.withColumn("_old", F.lit(True)))
    changes = D.emit_changes(rows).where(~F.col("_old")).drop("_old")
    last = rows.groupBy("entity_id", "metric").agg(F.max_by(F.struct(*[c for c in names if c not in ("entity_id", "metric")]), F.col("cycle")).alias("_r"))
    last = last.select("entity_id", "metric", "_r.*").select(*names)
    newest = last.agg(F.max("cycle")).scalar()
    return changes, last.where(F.col("cycle") >= newest - 1)


def stream_observe(
    long: DataFrame, model: ObserverModel | None, folder: str, span: int = 20, period_seconds: int = 60, predict: bool = True,
    graph: Callable[[DataFrame], DataFrame] | None = None, **trigger,
):
    """Start the observe cycle on a watermarked stream; returns the query.

    `<folder>/cycles/batch=N` holds, for the cycles that closed in micro-batch N, the rows that `observe` gives for them;
    `<folder>/active/N` each series' last anomaly. Both are written under the batch's number from the active table of the
    batch before, so that a batch that runs again after a failure replaces what it had written. All detectors, forecasts
    and merges are those of the batch plan, over the closed readings. `graph` turns a batch's readings into anomaly rows
    of a graph score.
    """
    spark = long.sparkSession

    def path(number: int) -> str:
        return f"{folder}/active/{number}"

    def cycle(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        active = spark.read.parquet(path(number - 1)) if number else None
        found = cut(detections(rows, model, span, period_seconds, predict, graph(rows) if graph else None))
        changes, last = follow(found, active)
        changes.write.mode("overwrite").parquet(f"{folder}/cycles/batch={number}")
        last.write.mode("overwrite").parquet(path(number))
        rows.unpersist()

    start = None if model is None else model.start
    closed = closed_readings(long, start, span, HISTORY, period_seconds)
    return closed.writeStream.foreachBatch(cycle).option("checkpointLocation", f"{folder}/state").trigger(**(trigger or {"availableNow": True})).start()


def observed(spark, folder: str) -> DataFrame:
    """All rows that a stream's batches have written so far."""
    return spark.read.parquet(f"{folder}/cycles").drop("batch")

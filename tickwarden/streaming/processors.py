"""Stateful stream operators. Each one has a batch counterpart it agrees with on the same rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickwarden.operators.detect import ewma_hits
from tickwarden.operators.outcomes import worsened
from tickwarden.operators.quality import sanitize
from tickwarden.operators.scan import ewma_before

WATERMARK = "5 minutes"


def readings(snapshots: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Long rows of a snapshot stream under a watermark; a row's sequence is its time."""
    rows = sanitize(snapshots).withColumn("seq", F.unix_micros("ts"))
    return rows.withWatermark("ts", delay)


def _sorted(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    # One key's rows of one micro-batch; the source's rate limit bounds them.
    return pd.concat(list(batches)).sort_values(order)


def stream_ewma(long: DataFrame, span: int = 20) -> DataFrame:
    """Score a telemetry stream with per-series count, mean and variance kept as state."""
    alpha = 2.0 / (span + 1)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _sorted(batches, ["ts", "seq"])
        n, mean, var = state.get if state.exists else (0, 0.0, 0.0)
        fresh = np.zeros(len(rows), dtype=bool)
        fresh[0] = n == 0
        means, variances, (mean, var) = ewma_before(rows["value"].to_numpy(dtype=float), fresh, alpha, mean, var)
        state.update((n + len(rows), mean, var))
        yield rows.assign(n_before=np.arange(n, n + len(rows)), mean_before=means, var_before=variances)

    names = ["ts", "entity_id", "entity_type", "metric", "value", "seq"]
    rows = long.select(*names)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", n_before bigint, mean_before double, var_before double"
    return rows.groupBy("entity_id", "metric").applyInPandasWithState(
        step, schema, "n bigint, mean double, variance double", "append", GroupStateTimeout.NoTimeout
    )


def stream_ewma_anomalies(long: DataFrame, span: int = 20) -> DataFrame:
    return ewma_hits(stream_ewma(long, span), span)


def stream_history(long: DataFrame, keep: int = 60) -> DataFrame:
    """Newest `keep` values per series after every micro-batch, oldest first."""
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _sorted(batches, ["ts", "seq"])
        old = list(state.get[0]) if state.exists else []
        values = (old + rows["value"].tolist())[-keep:]
        state.update((values,))
        last = rows.iloc[-1]
        yield pd.DataFrame({
            "entity_id": [key[0]], "metric": [key[1]], "ts": [last["ts"]], "seq": [last["seq"]], "values": [values],
        })

    return long.select("ts", "entity_id", "metric", "value", "seq").groupBy("entity_id", "metric").applyInPandasWithState(
        step, "entity_id string, metric string, ts timestamp, seq bigint, values array<double>",
        "values array<double>", "append", GroupStateTimeout.NoTimeout,
    )


LEVELS = ("low", "medium", "high", "critical")
SHARES = 1024  # shares of the keys; each is one group of a stream, whose state holds all series of its share


def shares(rows: DataFrame, keys: Sequence[str], n: int = SHARES) -> DataFrame:
    """Rows with the `share` of their key, by hash. A call per share, not per key, sees enough rows to work on arrays."""
    return rows.withColumn("share", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))


def numbered(entities: Sequence, metrics: Sequence) -> tuple[np.ndarray, list]:
    """The number of each row's series, in order of first appearance, and the series by number."""
    index: dict = {}
    ids = np.fromiter((index.setdefault(k, len(index)) for k in zip(entities, metrics)), dtype=np.int64, count=len(entities))
    return ids, list(index)


def stream_lifecycle(cycles: DataFrame, period_seconds: int = 60, min_delta: float = 0.05, n_shares: int = SHARES) -> DataFrame:
    """Open, change, keep and resolve anomalies per (entity, metric).

    `cycles`: ts (watermarked), cycle, entity_id, metric, severity, confidence[, seq]; any number of rows a cycle, in any
    order. A cycle is closed once the watermark has passed its end; its strongest row counts, the later one on ties, as
    in `cycle_peaks`. What follows agrees with `emit_changes` and `resolved` on the closed cycles. State holds the open
    cycles, at most as many as the watermark lags behind, and the last one, of all series of a share.
    """
    names = ["entity_id", "metric", "cycle", "severity", "confidence", "seq"]
    kinds = {"cycle": "i8", "confidence": "f8", "seq": "i8"}

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        passed = mark // (1000 * period_seconds)  # the first cycle that is open
        held = state.get if state.exists else ([], [], [], [], [], [], [])
        parts = [pd.DataFrame(dict(zip([*names, "last"], held))).astype({**kinds, "last": bool})]
        if not state.hasTimedOut:
            parts += [pdf[names].astype(kinds).assign(last=False) for pdf in batches]
        rows = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)
        rank = rows["severity"].map({s: i for i, s in enumerate(LEVELS)}).fillna(-1)
        rows = rows.assign(series=numbered(rows["entity_id"], rows["metric"])[0], rank=rank)
        # One row per series and cycle, the strongest one.
        rows = rows.sort_values(["rank", "confidence", "seq"], ascending=False, kind="stable", na_position="last")
        rows = rows.drop_duplicates(["series", "cycle", "last"]).sort_values(["series", "cycle", "last"], ascending=[True, True, False], kind="stable")
        rows = rows.reset_index(drop=True)
        waits = ~rows["last"].to_numpy() & (rows["cycle"].to_numpy() >= passed)
        done = rows[~waits]
        series, at, severity, confidence = (done[c].to_numpy() for c in ("series", "cycle", "severity", "confidence"))
        follows = np.zeros(len(done), dtype=bool)
        follows[1:] = (series[1:] == series[:-1]) & (at[1:] <= at[:-1] + 1)
        newest = np.ones(len(done), dtype=bool)
        newest[:-1] = series[1:] != series[:-1]
        moved = np.zeros(len(done), dtype=bool)
        moved[1:] = (severity[1:] != severity[:-1]) | (np.abs(confidence[1:] - confidence[:-1]).round(6) >= min_delta)
        found = done.assign(change=np.where(follows, np.where(moved, "changed", "unchanged"), "new"))[~done["last"].to_numpy()]
        ends = np.ones(len(done), dtype=bool)
        ends[:-1] = ~follows[1:]
        over = ends & (~newest | (at + 1 < passed))
        resolved = done[over].assign(change="resolved", cycle=at[over] + 1)
        kept = pd.concat([done[newest & ~over].assign(last=True), rows[waits]])
        if len(kept):
            due = int((kept["cycle"] + np.where(kept["last"], 2, 1)).min())
            state.update(tuple(kept[c].tolist() for c in [*names, "last"]))
            state.setTimeoutTimestamp(max(due * period_seconds * 1000, mark + 1))
        elif state.exists:
            state.remove()
        out = pd.concat([found, resolved]) if len(found) and len(resolved) else found if len(found) else resolved
        if len(out):
            yield out[["entity_id", "metric", "cycle", "severity", "confidence", "change"]].reset_index(drop=True)

    rows = cycles if "seq" in cycles.columns else cycles.withColumn("seq", F.unix_micros("ts"))
    return shares(rows, ["entity_id", "metric"], n_shares).groupBy("share").applyInPandasWithState(
        step, "entity_id string, metric string, cycle bigint, severity string, confidence double, change string",
        "entities array<string>, metrics array<string>, cycles array<bigint>, severities array<string>, confidences array<double>, "
        "seqs array<bigint>, lasts array<boolean>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def stream_rate_limit(actions: DataFrame, scope: str = "scope", most: int = 3, minutes: int = 10) -> DataFrame:
    """Accept an action when fewer than `most` were accepted in its scope in the trailing window.

    Rejected actions do not count. `actions`: action_id, ts, scope.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _sorted(batches, ["ts", "action_id"])
        taken = list(state.get[0]) if state.exists else []
        verdicts = []
        for ts in rows["ts"]:
            at = int(pd.Timestamp(ts).value // 1000)
            taken = [t for t in taken if t >= at - minutes * 60_000_000]
            fine = len(taken) < most
            verdicts.append(fine)
            if fine:
                taken.append(at)
        state.update((taken,))
        yield rows[["action_id", "ts"]].assign(scope=key[0], accepted=verdicts)[["action_id", "ts", "scope", "accepted"]]

    rows = actions.select("action_id", "ts", F.col(scope).alias("scope"))
    return rows.groupBy("scope").applyInPandasWithState(
        step, f"action_id {dict(rows.dtypes)['action_id']}, ts timestamp, scope {dict(rows.dtypes)['scope']}, accepted boolean",
        "taken array<bigint>", "append", GroupStateTimeout.NoTimeout,
    )


def stream_monitor(actions: DataFrame, long: DataFrame, minutes: int = 10) -> DataFrame:
    """Readings in the window after an action that are 20 % worse than before it. Both inputs are watermarked.

    `actions`: action_id, ts, entity_id, metric, pre. The interval bounds the state kept on both sides.
    """
    left = actions.select("action_id", F.col("ts").alias("action_ts"), F.col("entity_id").alias("_e"), F.col("metric").alias("_m"), "pre")
    after = (F.col("ts") > F.col("action_ts")) & (F.col("ts") <= F.col("action_ts") + F.expr(f"INTERVAL {minutes} MINUTES"))
    joined = left.join(long, (F.col("_e") == F.col("entity_id")) & (F.col("_m") == F.col("metric")) & after)
    return joined.where(worsened(F.col("metric"), F.col("pre"), F.col("value"))).select(
        "action_id", "action_ts", "entity_id", "metric", "pre", "ts", "value"
    )


def first_breach(breaches: DataFrame) -> DataFrame:
    """One rollback signal per action."""
    return breaches.dropDuplicatesWithinWatermark(["action_id"])


def stream_approvals(actions: DataFrame, approvals: DataFrame, hours: int = 1) -> DataFrame:
    """Held actions with their approval, or without one once the waiting time has passed. Both are watermarked.

    `actions`: action_id, ts. `approvals`: action_id, ts, operator.
    """
    said = approvals.select(F.col("action_id").alias("_id"), F.col("ts").alias("approved_ts"), "operator")
    inside = F.expr(f"approved_ts >= ts AND approved_ts <= ts + INTERVAL {hours} HOURS")
    joined = actions.join(said, (F.col("action_id") == F.col("_id")) & inside, "leftOuter")
    return joined.select(
        "action_id", "ts", "approved_ts", "operator",
        F.when(F.col("approved_ts").isNull(), "expired").otherwise("approved").alias("status"),
    )


def active_scenarios(ticks: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Stream of ticks with the scenarios still running; a scenario leaves once its end has passed."""
    from tickwarden.operators.intervals import interval_join

    windows = scenarios.select("scenario_id", "scenario_type", "start_time", "end_time")
    return interval_join(ticks, windows, "start_time", "end_time")


def run_counters(rows: DataFrame, *keys: str) -> DataFrame:
    """Running counts of anomalies and of actions that worked or failed, from rows (kind, ok)."""
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "anomaly").alias("anomalies"),
        F.count_if((F.col("kind") == "action") & F.col("ok")).alias("actions_ok"),
        F.count_if((F.col("kind") == "action") & ~F.col("ok")).alias("actions_failed"),
    )


def late(us: np.ndarray, watermark_ms: int) -> np.ndarray:
    """Which times, in microseconds, the watermark has passed."""
    return us <= watermark_ms * 1000


def mark_late(rows: DataFrame, keys: Sequence[str] = ("entity_id", "metric"), n_shares: int = SHARES) -> DataFrame:
    """All rows of a watermarked stream with `late`: whether the watermark had passed their time when they came.

    Rows are dealt into shares by their keys, a call each, and nothing is kept. Stateful steps leave exactly the late rows out,
    so that this is their side output: `late` rows can go to a table of their own.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", late boolean"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        for pdf in batches:
            us = pdf["_us"].to_numpy()
            yield pdf.drop(columns=["_us", "share"]).assign(late=late(us, mark))

    marked = shares(rows.withColumn("_us", F.unix_micros("ts")), keys, n_shares)
    return marked.groupBy("share").applyInPandasWithState(step, schema, "nothing boolean", "append", GroupStateTimeout.NoTimeout)


def late_rows(query) -> int:
    """Rows a running query has dropped behind its watermark."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])

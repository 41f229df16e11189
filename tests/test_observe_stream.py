from __future__ import annotations

import datetime as dt
import random

import numpy as np

from tests.conftest import minute
from tickwarden.operators import detect as D
from tickwarden.operators.scan import affine_scan, ewma_before, ewma_of_series
from tickwarden.plans import observer
from tickwarden.sources.io import write_batches
from tickwarden.streaming import observe as SO
from tickwarden.streaming import processors as SP
from tickwarden.streaming.cycle import drain

LONG = "ts timestamp, entity_id string, entity_type string, metric string, value double, seq bigint"


def plain_ewma(x, alpha, n=0, mean=0.0, var=0.0):
    out = []
    for v in x:
        if n == 0:
            mean, var = v, 0.0
        out.append((mean, var))
        if n:
            diff = v - mean
            mean, var = mean + alpha * diff, (1 - alpha) * (var + alpha * diff * diff)
        n += 1
    return out, (mean, var)


def test_scan_equals_the_recurrence():
    rnd = np.random.default_rng(1)
    a, b = rnd.random(3000), rnd.normal(size=3000)
    a[rnd.random(3000) < 0.01] = 0.0
    y, want = 0.0, []
    for p, q in zip(a, b):
        y = p * y + q
        want.append(y)
    assert np.allclose(affine_scan(a, b), want, rtol=1e-12, atol=1e-12)
    x, cuts, alpha = rnd.normal(50, 20, 4000), [0, 1, 17, 300, 301, 2000], 2 / 21
    fresh = np.zeros(4000, bool)
    fresh[cuts] = True
    mean, var, end = ewma_before(x, fresh, alpha)
    expected = []
    for lo, hi in zip(cuts, [*cuts[1:], 4000]):
        rows, last = plain_ewma(x[lo:hi], alpha)
        expected += rows
    assert np.allclose(np.column_stack([mean, var]), expected, rtol=1e-9) and np.allclose(end, last, rtol=1e-9)
    mean, var, _ = ewma_before(x[:50], np.zeros(50, bool), alpha, 40.0, 9.0)
    assert np.allclose(np.column_stack([mean, var]), plain_ewma(x[:50], alpha, 5, 40.0, 9.0)[0], rtol=1e-9)


def test_series_of_a_share_do_not_meet():
    x = np.array([1.0, np.nan, 3.0, 4.0, 5.0, 6.0, 7.0])
    fresh, goes_on = (np.isin(np.arange(7), at) for at in ([0, 2], [5]))
    before, spread, after, _ = ewma_of_series(x, fresh, goes_on, np.full(7, 10.0), np.full(7, 2.0), 0.5)
    assert np.isnan(after[1]) and before[:6].tolist() == [1.0, 1.0, 3.0, 3.0, 3.5, 10.0] and before[6] == 8.0 and spread[5] == 2.0


def readings(rnd, minutes, start=0):
    rows, seq = [], start * 100
    for i in range(start, start + minutes):
        for e, kind, metric in [("AGG1", "node", "cpu_pct"), ("AGG1", "node", "memory_pct"), ("AGG1-EDGE1", "link", "utilization_pct"), ("AGG1-EDGE1", "link", "latency_ms")]:
            seq += 1
            base = 5.0 if metric == "latency_ms" else 60.0
            hot = metric != "memory_pct" and 25 <= i % 60 < 40 and i >= 90
            rows.append((minute(i + rnd.random() * 0.9), e, kind, metric, base * (1.2 + i % 9 / 20 if hot else 1) + rnd.gauss(0, 1), seq))
    return rows


def test_stream_equals_batch_observe(spark, links, tmp_path):
    rnd = random.Random(5)
    baseline = spark.createDataFrame(readings(rnd, 90), LONG)
    rows = readings(rnd, 120, 90)
    model = observer.fit(baseline, links, trees=10)
    # Readings come in eight batches, some one batch later, and every tenth twice.
    arrivals = [(*r, i * 8 // len(rows) + (i % 7 == 0)) for i, r in enumerate(rows)] + [(*r, i * 8 // len(rows)) for i, r in enumerate(rows) if i % 10 == 0]
    folder = str(tmp_path / "in")
    write_batches(spark.createDataFrame(arrivals, LONG + ", batch int"), folder, "batch", files=1)
    stream = spark.readStream.schema(LONG).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", "40 minutes")
    query = SO.stream_observe(stream, model, str(tmp_path / "out"))
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) >= 8
    got = SO.observed(spark, str(tmp_path / "out"))
    names = ["cycle", "entity_id", "metric", "observed", "expected", "severity", "confidence", "detector", "seq", "change"]
    # The last forty minutes lie behind no watermark yet.
    closed = int((max(r[0] for r in rows) - dt.timedelta(minutes=40)).timestamp() * 1000 // 60000)
    want = observer.observe(baseline, spark.createDataFrame(rows, LONG), model).where(f"cycle < {closed}")
    want = sorted(map(tuple, want.select(*names).collect()))
    assert len({w[-1] for w in want}) == 3 and len({w[-3] for w in want}) >= 3
    assert sorted(map(tuple, got.select(*names).collect())) == want
    # A batch that runs again replaces its own rows.
    before = got.count()
    changes, _ = SO.follow(spark.read.parquet(str(tmp_path / "out" / "cycles" / "batch=3")).drop("change"), spark.read.parquet(str(tmp_path / "out" / "active" / "2")))
    changes.write.mode("overwrite").parquet(str(tmp_path / "again"))
    spark.read.parquet(str(tmp_path / "again")).write.mode("overwrite").parquet(str(tmp_path / "out" / "cycles" / "batch=3"))
    again = SO.observed(spark, str(tmp_path / "out"))
    assert again.count() == before and sorted(map(tuple, again.select(*names).collect())) == want


def test_late_rows_go_aside_and_repeats_count_once(spark, tmp_path):
    batches = [[0, 1, 2], [30, 3, 25, 25], [31, 10, 26], [60]]
    rows = [(minute(m), "A", "node", "cpu_pct", float(m), m, b) for b, ms in enumerate(batches) for m in ms]
    folder = str(tmp_path / "in")
    write_batches(spark.createDataFrame(rows, LONG + ", batch int"), folder, "batch", files=1)

    def stream():
        return spark.readStream.schema(LONG).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", "5 minutes")

    marked = drain(SP.mark_late(stream()), str(tmp_path / "a")).collect()
    # Watermarks before each batch: none, -3, 25 and 26 minutes.
    assert sorted((r["seq"], r["late"]) for r in marked) == sorted([(0, False), (1, False), (2, False), (30, False), (3, False), (25, False), (25, False), (31, False), (10, True), (26, False), (60, False)])
    closed = drain(SO.closed_readings(stream()), str(tmp_path / "b")).collect()
    assert sorted((r["seq"], r["n_before"]) for r in closed) == [(0, 0), (1, 1), (2, 2), (3, 3), (25, 4), (26, 5), (30, 6), (31, 7)]
    last = next(r for r in closed if r["seq"] == 31)
    assert last["history"] == [0.0, 1.0, 2.0, 3.0, 25.0, 26.0, 30.0, 31.0]


def test_follow_ends_what_cannot_go_on(spark):
    schema = "cycle bigint, entity_id string, metric string, observed double, expected double, severity string, confidence double, detector string, seq bigint"
    row = lambda c, e, s="high", f=0.7: (c, e, "m", 1.0, 1.0, s, f, "threshold", c)
    changes, active = SO.follow(spark.createDataFrame([row(1, "A"), row(2, "A"), row(1, "B")], schema), None)
    assert sorted((r["cycle"], r["entity_id"], r["change"]) for r in changes.collect()) == [(1, "A", "new"), (1, "B", "new"), (2, "A", "unchanged")]
    changes, active = SO.follow(spark.createDataFrame([row(3, "A", "low"), row(4, "A", "low", 0.8), row(3, "B")], schema), active)
    assert sorted((r["cycle"], r["entity_id"], r["change"]) for r in changes.collect()) == [(3, "A", "changed"), (3, "B", "new"), (4, "A", "changed")]
    assert sorted((r["cycle"], r["entity_id"]) for r in active.collect()) == [(3, "B"), (4, "A")]
    assert D.emit_changes(active).count() == 2

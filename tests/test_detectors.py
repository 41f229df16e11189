import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import minute
from tickwarden.operators import detect as D
from tickwarden.operators import forecast as FC
from tickwarden.operators import forest as IF


def by_key(rows):
    return {(r["entity_id"], r["metric"]): r for r in rows}


def test_threshold_known_answers(long_rows, links):
    long = long_rows({
        ("CR1-CR2", "link", "utilization_pct"): [92], ("CR1-CR2", "link", "packet_loss_pct"): [0.5],
        ("CR1-CR2", "link", "latency_ms"): [18], ("CR1", "node", "cpu_pct"): [95], ("CR1", "node", "temperature_c"): [65],
        ("CR1-CR2", "link", "throughput_gbps"): [1e9], ("CR2", "node", "cpu_pct"): [90],
    })
    found = by_key(D.threshold(latency=D.latency_baselines(links))(long).collect())
    assert {k: v["severity"] for k, v in found.items()} == {
        ("CR1-CR2", "utilization_pct"): "medium", ("CR1-CR2", "latency_ms"): "critical", ("CR1", "cpu_pct"): "medium",
    }
    assert found[("CR1-CR2", "latency_ms")]["expected"] == 12.5
    raised = by_key(D.threshold({"cpu_pct": 96.0})(long).collect())
    assert ("CR1", "cpu_pct") not in raised


def test_latency_baseline_prefers_measured(long_rows, links):
    measured = D.baselines(long_rows({("CR1-CR2", "link", "latency_ms"): [7, 9], ("X-Y", "link", "latency_ms"): [3]}))
    table = {r["entity_id"]: r["baseline_ms"] for r in D.latency_baselines(links, measured).collect()}
    assert table["CR1-CR2"] == 8.0 and table["X-Y"] == 3.0 and table["AGG1-CR1"] == 2.0


SERIES = [50, 52, 49, 51, 50, 53, 48, 50, 51, 49, 52, 90]


def test_ewma_known_answer(long_rows):
    long = long_rows({("CR1", "node", "cpu_pct"): SERIES})
    scored = D.ewma(long)
    last = scored.orderBy(F.desc("ts")).first()
    assert last["n_before"] == 11
    assert last["mean_before"] == pytest.approx(50.3097397537, abs=1e-9)
    assert math.sqrt(last["var_before"]) == pytest.approx(1.2119745845, abs=1e-9)
    hits = D.ewma_hits(scored).collect()
    assert len(hits) == 1 and hits[0]["severity"] == "critical" and hits[0]["confidence"] == 0.95
    end = D.ewma_end_state(scored).first()
    assert end["n"] == 12
    assert end["mean"] == pytest.approx(54.0897645391, abs=1e-9) and end["variance"] == pytest.approx(137.0705689225, abs=1e-8)


def recurrence(values, alpha=2 / 21):
    mean, var, out = None, 0.0, []
    for x in values:
        out.append((x if mean is None else mean, var))
        if mean is None:
            mean = x
            continue
        d = x - mean
        mean, var = mean + alpha * d, (1 - alpha) * (var + alpha * d * d)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_ewma_split_series_equals_recurrence(spark, parts):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(50, 5, 4000), rng.normal(5000, 900, 500), rng.normal(3, 0.1, 4500)])
    rows = [(minute(i), "hot", "cpu_pct", float(v), i) for i, v in enumerate(values)]
    rows += [(minute(i), "cold", "cpu_pct", float(i), i) for i in range(20)]
    long = spark.createDataFrame(rows, "ts timestamp, entity_id string, metric string, value double, seq bigint").repartition(parts)
    got = D.ewma(long, max_rows=1000, chunk_rows=2000).where("entity_id = 'hot'").orderBy("seq").collect()
    assert len(got) == len(values)
    want = np.array(recurrence(values.tolist()))
    assert np.allclose([r["mean_before"] for r in got], want[:, 0], rtol=1e-12, atol=1e-9)
    assert np.allclose([r["var_before"] for r in got], want[:, 1], rtol=1e-9, atol=1e-9)
    late = [r["n_before"] for r in got]
    assert late == list(range(len(values)))


def anomaly_rows(spark, rows):
    return spark.createDataFrame(
        rows, "ts timestamp, entity_id string, metric string, observed double, expected double, severity string, confidence double, detector string, seq bigint"
    )


def test_ensemble_boost_and_tie(spark):
    rows = anomaly_rows(spark, [
        (minute(0), "CR1", "cpu_pct", 95.0, 90.0, "medium", 0.7, "threshold", 0),
        (minute(0), "CR1", "cpu_pct", 95.0, 50.0, "critical", 0.7, "ewma", 0),
        (minute(0), "CR2", "cpu_pct", 95.0, 90.0, "high", 0.95, "ewma", 1),
    ])
    out = {r["entity_id"]: r for r in D.ensemble(rows).collect()}
    assert out["CR1"]["detector"] == "threshold" and out["CR1"]["confidence"] == 0.85 and out["CR1"]["severity"] == "medium"
    assert out["CR2"]["confidence"] == 0.95


def cycle_rows(spark, rows):
    return spark.createDataFrame(rows, "cycle bigint, entity_id string, metric string, severity string, confidence double")


def test_emit_suppress_emit_and_gap(spark):
    cycles = cycle_rows(spark, [(1, "A", "m", "high", 0.70), (2, "A", "m", "high", 0.73), (3, "A", "m", "high", 0.82), (5, "A", "m", "high", 0.82)])
    out = [(r["cycle"], r["change"]) for r in D.emit_changes(cycles).orderBy("cycle").collect()]
    assert out == [(1, "new"), (2, "unchanged"), (3, "changed"), (5, "new")]
    assert [(r["cycle"], r["entity_id"]) for r in D.resolved(cycles).collect()] == [(4, "A")]


def test_observed_beats_predicted(spark):
    keys = ["cycle", "entity_id", "metric"]
    schema = "cycle bigint, entity_id string, metric string, severity string, confidence double, detector string, seq bigint"
    observed = spark.createDataFrame([(1, "A", "m", "low", 0.1, "ewma", 1), (1, "A", "m", "high", 0.2, "graph", 2)], schema)
    predicted = spark.createDataFrame([(1, "A", "m", "critical", 0.9, "forecast_predicted", 3), (1, "B", "m", "low", 0.9, "forecast_predicted", 4)], schema)
    out = {r["entity_id"]: r["detector"] for r in D.merge_predicted(observed, predicted, keys).collect()}
    assert out == {"A": "graph", "B": "forecast_predicted"}


@pytest.mark.parametrize(
    "active, state, worst",
    [
        ([("CR1", "low", 0.5)], "healthy", "CR1"),
        ([("CR1", "medium", 0.6), ("CR1-CR2", "high", 0.7)], "degraded", "CR1-CR2"),
        ([("CR1", "medium", 0.6), ("CR1-CR2", "high", 0.7), ("CR2", "critical", 0.5)], "critical", "CR2"),
        ([("A", "low", 0.5), ("B", "low", 0.5), ("C", "low", 0.6)], "degraded", "C"),
    ],
)
def test_health(spark, active, state, worst):
    row = D.health_summary(spark.createDataFrame(active, "entity_id string, severity string, confidence double")).first()
    assert (row["overall_health"], row["worst_entity"], row["total_anomalies"]) == (state, worst, len(active))


def test_forecast_known_answers(long_rows):
    n = range(35)
    long = long_rows({
        ("CR1-CR2", "link", "utilization_pct"): [74 + 0.55 * i for i in n], ("CR1", "node", "cpu_pct"): [78 + 0.45 * i for i in n],
        ("CR1", "node", "memory_pct"): [0.9 * (78 + 0.45 * i) for i in n], ("CR1", "node", "temperature_c"): [64 + 0.35 * i for i in n],
    })
    rows = by_key(FC.forecast_trend(long).collect())
    util = rows[("CR1-CR2", "utilization_pct")]
    assert util["level"] == pytest.approx(90.227694, abs=1e-6) and util["slope"] == pytest.approx(0.55, abs=1e-9)
    assert util["peak"] == pytest.approx(95.727694, abs=1e-4) and util["minutes_until"] == 1
    want = {"utilization_pct": 0.7868, "cpu_pct": 0.7606, "memory_pct": 0.6377, "temperature_c": 0.7892}
    assert {k[1]: r["confidence"] for k, r in rows.items()} == pytest.approx(want, abs=2e-4)
    assert rows[("CR1", "memory_pct")]["minutes_until"] == 8
    hits = {r["metric"]: r["severity"] for r in FC.predicted_anomalies(FC.forecast_trend(long)).collect()}
    assert hits == {"utilization_pct": "high", "cpu_pct": "medium", "memory_pct": "medium", "temperature_c": "high"}


def test_linear_forecast_learns_a_ramp(long_rows):
    long = long_rows({(f"L{k}", "link", "utilization_pct"): [10 + k + 0.5 * i for i in range(100)] for k in range(4)})
    model = FC.fit_linear(long)
    row = FC.forecast_linear(long, model).where("entity_id = 'L0'").first()
    assert row["predictions"][0] == pytest.approx(10 + 0.5 * 100, abs=0.5)
    assert row["predictions"][9] == pytest.approx(10 + 0.5 * 109, abs=0.5)
    assert row["uncertainty"] < 0.3 and not row["high_uncertainty"]


def test_series_forecasts_match_least_squares_of_each_series(long_rows):
    rng = np.random.default_rng(3)
    lags, ahead, strength = 3, 2, 5.0
    values = {f"L{k}": (50 + rng.normal(0, 5, n).cumsum()).tolist() for k, n in enumerate((40, 25, 4, 2))}
    values["FLAT"] = [7.0] * 12
    long = long_rows({(e, "link", "utilization_pct"): v for e, v in values.items()}).repartition(5)
    sums = FC.series_sums(long, lags=lags, ahead=ahead)
    got = {r["entity_id"]: r for r in FC.forecast_series(long, sums, lags=lags, ahead=ahead, strength=strength).collect()}
    assert set(got) == {"L0", "L1", "L2", "FLAT"}  # L3 is shorter than the lags

    def scaled(v):
        return (np.array(v) - min(v)) / ((max(v) - min(v)) or 1.0)

    z = {e: np.array([[1, *scaled(v)[i:i + lags + ahead]] for i in range(len(v) - lags - ahead + 1)]).reshape(-1, 1 + lags + ahead) for e, v in values.items()}
    every = np.concatenate(list(z.values()))
    for e, row in got.items():
        s = z[e].T @ z[e] + strength * every.T @ every / len(every)
        fitted = np.linalg.solve(s[:1 + lags, :1 + lags] + 1e-3 * np.eye(1 + lags), s[:1 + lags, 1 + lags:])
        want = np.r_[1, scaled(values[e])[-lags:]] @ fitted * ((max(values[e]) - min(values[e])) or 1.0) + min(values[e])
        assert row["predictions"] == pytest.approx(want.tolist(), abs=2e-4) and row["windows"] == len(z[e])
    assert FC.forecast_series(long.limit(0), FC.series_sums(long.limit(0), lags=2), lags=2).count() == 0


def test_forest_flags_outliers_and_ignores_partitioning(long_rows):
    rng = np.random.default_rng(5)
    values = rng.normal(50, 3, 2000).tolist() + [200.0, -100.0]
    long = long_rows({("A", "node", "cpu_pct"): values, ("A", "node", "memory_pct"): [1.0] * 5})
    out = []
    for parts in (1, 7):
        rows = long.repartition(parts)
        steps = IF.fit_forest(rows)
        scored = IF.score_forest(rows, steps)
        hits = IF.forest_hits(scored, IF.forest_offsets(scored), steps.select("metric", "median"))
        out.append({r["seq"]: round(r["confidence"], 6) for r in hits.collect()})
    assert out[0] == out[1]
    assert {2000, 2001} <= set(out[0]) and len(out[0]) <= 0.06 * len(values)

"""Detection, forecasting and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwarden.contract.registry import RANK, query, sql
from tickwarden.functions import severity as SV
from tickwarden.operators import detect as D
from tickwarden.operators import forecast as FC
from tickwarden.operators import forest as IF
from tickwarden.operators import graphscore as G
from tickwarden.operators.reshape import node_features
from tickwarden.plans.observer import rolling_predictions
from tickwarden.schemas import NODE_METRICS
from tickwarden.sources import tables as T



def day():
    return F.floor(F.unix_seconds("ts") / 86400)


def micros():
    return F.unix_micros("ts").alias("ts_us")


def shown(rows, *extra):
    return rows.select(micros(), "entity_id", "metric", "observed", "expected", "severity", "confidence", *extra)


def threshold_rows(spark, d):
    return D.threshold(latency=D.latency_baselines(T.links(spark, d)))(T.telemetry(spark, d))


def ewma_rows(spark, d):
    return D.ewma_hits(D.ewma(T.telemetry(spark, d)))


def ensemble_rows(spark, d):
    return D.ensemble(threshold_rows(spark, d).unionByName(ewma_rows(spark, d)))


def cycles(spark, d):
    return D.cycle_peaks(ensemble_rows(spark, d).withColumn("cycle", day()))


query("baseline_mean", sql("tel", "SELECT entity_id, metric, round(avg(value), 6) AS baseline FROM tel GROUP BY ALL"))(
    lambda spark, d: D.baselines(T.telemetry(spark, d)).withColumn("baseline", F.round("baseline", 6))
)
query("first_baseline", sql("tel", "SELECT entity_id, metric, arg_min(value, {'ts': ts, 'seq': seq}) AS baseline FROM tel GROUP BY ALL"))(
    lambda spark, d: D.first_baselines(T.telemetry(spark, d))
)
query("describe_entity", sql("tel", """
SELECT entity_id, metric, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM tel GROUP BY ALL"""))(
    lambda spark, d: D.describe_series(T.telemetry(spark, d)).withColumn("mean", F.round("mean", 6))
)
query("threshold_anomalies", sql("thr", """
SELECT epoch_us(ts) AS ts_us, entity_id, metric, observed, expected, severity, confidence FROM thr"""))(
    lambda spark, d: shown(threshold_rows(spark, d))
)


@query("threshold_override", sql("utel", """
SELECT epoch_us(ts) AS ts_us, entity_id, metric, round(value, 6) AS observed, lim AS expected,
       CASE WHEN value / lim >= 1.3 THEN 'critical' WHEN value / lim >= 1.1 THEN 'high' ELSE 'medium' END AS severity, 0.7::DOUBLE AS confidence
FROM (SELECT *, CASE metric WHEN 'utilization_pct' THEN 85.0::DOUBLE WHEN 'packet_loss_pct' THEN 1.0::DOUBLE WHEN 'cpu_pct' THEN 120.0::DOUBLE
             WHEN 'throughput_gbps' THEN 200.0::DOUBLE WHEN 'latency_ms' THEN 15.0::DOUBLE END AS lim FROM utel) WHERE value > lim"""))
def threshold_override(spark, d):
    limits = {"cpu_pct": 120.0, "throughput_gbps": 200.0, "latency_ms_factor": 3.0}
    return shown(D.threshold(limits)(T.user_telemetry(spark, d)))


@query("severity_bands", sql("", """
SELECT observed, predicted, sigmas, isolation, rank, count(*) AS n, round(sum(value6), 4) AS total, round(sum(conf), 4) AS confidence FROM (
  SELECT CASE WHEN r >= 1.3 THEN 'critical' WHEN r >= 1.1 THEN 'high' ELSE 'medium' END AS observed,
         CASE WHEN r >= 1.25 THEN 'critical' WHEN r >= 1.1 THEN 'high' WHEN r >= 1.0 THEN 'medium' ELSE 'low' END AS predicted,
         CASE WHEN value / 20 >= 5 THEN 'critical' WHEN value / 20 >= 4 THEN 'high' ELSE 'medium' END AS sigmas,
         CASE WHEN value / 200 >= 0.3 THEN 'critical' WHEN value / 200 >= 0.2 THEN 'high' WHEN value / 200 >= 0.1 THEN 'medium' ELSE 'low' END AS isolation,
         CASE WHEN r >= 1.25 THEN 3 WHEN r >= 1.1 THEN 2 WHEN r >= 1.0 THEN 1 ELSE 0 END AS rank,
         round(value, 6) AS value6, least(greatest(round(value / 300, 4), 0.0), 0.99) AS conf
  FROM (SELECT value, value / 60 AS r FROM events)) GROUP BY ALL"""))
def severity_bands(spark, d):
    v = F.col("value")
    rows = T.table(spark, d, "events").select(
        SV.observed_severity(v / 60).alias("observed"), SV.predicted_severity(v / 60).alias("predicted"),
        SV.sigma_severity(v / 20).alias("sigmas"), SV.isolation_severity(-v / 200).alias("isolation"),
        SV.severity_rank(SV.predicted_severity(v / 60)).alias("rank"),
        SV.report_value(v).alias("value6"), SV.report_confidence(v / 300).alias("conf"),
    )
    return rows.groupBy("observed", "predicted", "sigmas", "isolation", "rank").agg(
        F.count("*").alias("n"), F.round(F.sum("value6"), 4).alias("total"), F.round(F.sum("conf"), 4).alias("confidence")
    )


@query("status_bands", sql("state links", """
SELECT l.link_id AS entity_id, CASE WHEN u IS NULL THEN 'unknown' WHEN u >= 85 THEN 'hot' WHEN u >= 70 THEN 'busy' WHEN u >= 50 THEN 'warm' ELSE 'calm' END AS band,
       CASE WHEN coalesce(u, 0) = 0 AND coalesce(p, 0) >= 99 THEN 'down' WHEN coalesce(u, 0) >= 90 OR coalesce(p, 0) >= 5 THEN 'congested'
            WHEN coalesce(u, 0) >= 70 OR coalesce(p, 0) >= 1 OR coalesce(t, 0) > l.latency_baseline_ms * 2.5 THEN 'degraded' ELSE 'healthy' END AS status
FROM links l LEFT JOIN (SELECT entity_id, max(value) FILTER (metric = 'utilization_pct') AS u, max(value) FILTER (metric = 'packet_loss_pct') AS p,
                               max(value) FILTER (metric = 'latency_ms') AS t FROM state GROUP BY 1) s ON s.entity_id = l.link_id
UNION ALL
SELECT entity_id, 'node', CASE WHEN value >= 95 THEN 'critical' WHEN value >= 75 THEN 'degraded' ELSE 'healthy' END FROM state WHERE metric = 'cpu_pct'"""))
def status_bands(spark, d):
    state = T.state(spark, d)
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    wide = state.groupBy("entity_id").agg(
        pick("utilization_pct").alias("u"), pick("packet_loss_pct").alias("p"), pick("latency_ms").alias("t")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    links = T.links(spark, d).select(F.col("link_id").alias("entity_id"), "latency_baseline_ms").join(wide, "entity_id", "left").select(
        "entity_id", SV.utilization_band(F.col("u")).alias("band"),
        SV.link_status(zero("u"), zero("p"), zero("t"), F.col("latency_baseline_ms")).alias("status"),
    )
    nodes = state.where("metric = 'cpu_pct'").select(
        "entity_id", F.lit("node").alias("band"), SV.node_status(F.col("value"), F.lit(0.0), F.lit(0.0)).alias("status")
    )
    return links.unionByName(nodes)


EWMA_BY_METRIC = sql("tel", """
WITH ord AS (SELECT metric, seq, value, row_number() OVER (PARTITION BY metric ORDER BY ts, seq) AS rn FROM tel),
run AS (SELECT metric, seq, rn, value, value AS m0, 0.0::DOUBLE AS v0, value AS m, 0.0::DOUBLE AS v FROM ord WHERE rn = 1
  UNION ALL
  SELECT o.metric, o.seq, o.rn, o.value, r.m, r.v, r.m + (o.value - r.m) * (2.0::DOUBLE / 21),
         (1 - 2.0::DOUBLE / 21) * (r.v + (2.0::DOUBLE / 21) * (o.value - r.m) * (o.value - r.m))
  FROM run r JOIN ord o ON o.metric = r.metric AND o.rn = r.rn + 1)
SELECT metric, seq, rn - 1 AS n_before, round(m0, 6) AS mean_before, round(v0, 5) AS var_before FROM run""", recursive=True)


@query("ewma_state", EWMA_BY_METRIC)
def ewma_state(spark, d):
    """One series per metric over the whole network: the long-series case."""
    rows = D.ewma(T.telemetry(spark, d), keys=["metric"])
    return rows.select("metric", "seq", "n_before", F.round("mean_before", 6).alias("mean_before"), F.round("var_before", 5).alias("var_before"))


@query("ewma_state_chunked", EWMA_BY_METRIC)
def ewma_state_chunked(spark, d):
    """The same rows through the path for series too long for one task."""
    rows = D.ewma(T.telemetry(spark, d), keys=["metric"], max_rows=500, chunk_rows=3000)
    return rows.select("metric", "seq", "n_before", F.round("mean_before", 6).alias("mean_before"), F.round("var_before", 5).alias("var_before"))


query("ewma_end_state", sql("tel", """
SELECT entity_id, metric, count(*) AS n, round(list_reduce(list({'m': value, 'v': 0.0::DOUBLE} ORDER BY ts, seq), lambda a, x: {'m': a.m + (x.m - a.m) * (2.0::DOUBLE / 21),
  'v': (1 - 2.0::DOUBLE / 21) * (a.v + (2.0::DOUBLE / 21) * (x.m - a.m) * (x.m - a.m))}).m, 6) AS mean FROM tel GROUP BY ALL"""))(
    lambda spark, d: D.ewma_end_state(D.ewma(T.telemetry(spark, d))).select("entity_id", "metric", "n", F.round("mean", 6).alias("mean"))
)
query("ewma_anomalies", sql("ewh", """
SELECT epoch_us(ts) AS ts_us, entity_id, metric, observed, expected, severity, confidence FROM ewh"""))(
    lambda spark, d: shown(ewma_rows(spark, d))
)
query("ensemble_dedup", sql("ens", """
SELECT epoch_us(ts) AS ts_us, entity_id, metric, observed, expected, severity, confidence, detector, votes FROM ens"""))(
    lambda spark, d: shown(ensemble_rows(spark, d), "detector", "votes")
)

PEAKS = f"""peaks AS (
SELECT epoch_us(ts) // 86400000000 AS cycle, entity_id, metric, max_by({{'severity': severity, 'confidence': confidence, 'seq': seq}},
       {{'r': {RANK.format('severity')}, 'c': confidence, 's': seq}}) AS b FROM ens GROUP BY ALL),
cyc AS (SELECT cycle, entity_id, metric, b.severity AS severity, b.confidence AS confidence FROM peaks)"""

query("emit_changes", sql("ens", f"""WITH {PEAKS}
SELECT c.cycle, c.entity_id, c.metric, c.severity, c.confidence,
       CASE WHEN p.severity IS NULL THEN 'new' WHEN c.severity <> p.severity OR round(abs(c.confidence - p.confidence), 6) >= 0.05 THEN 'changed' ELSE 'unchanged' END AS change
FROM cyc c LEFT JOIN cyc p ON p.cycle = c.cycle - 1 AND p.entity_id = c.entity_id AND p.metric = c.metric"""))(
    lambda spark, d: D.emit_changes(cycles(spark, d)).select("cycle", "entity_id", "metric", "severity", "confidence", "change")
)
query("resolved_anomalies", sql("ens", f"""WITH {PEAKS}
SELECT c.cycle + 1 AS cycle, c.entity_id, c.metric FROM cyc c LEFT JOIN cyc p ON p.cycle = c.cycle + 1 AND p.entity_id = c.entity_id AND p.metric = c.metric
WHERE p.cycle IS NULL AND c.cycle < (SELECT max(cycle) FROM cyc)"""))(
    lambda spark, d: D.resolved(cycles(spark, d)).select("cycle", "entity_id", "metric")
)
HEALTH = f"""
SELECT epoch_us(ts) // 86400000000 AS day, count(*) AS total_anomalies, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium,
       count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical,
       max_by(entity_id, {{'r': {RANK.format('severity')}, 'c': confidence, 'e': entity_id}}) AS worst_entity,
       CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'critical'
            WHEN count(*) FILTER (severity IN ('high', 'medium')) > 0 OR count(*) >= 3 THEN 'degraded' ELSE 'healthy' END AS overall_health
FROM ens GROUP BY 1"""
query("health_summary", sql("ens", HEALTH))(
    lambda spark, d: D.health_summary(ensemble_rows(spark, d).withColumn("day", day()), "day")
)
query("severity_share", sql("ens", f"""
SELECT day, round(least(100.0 * critical / greatest(total_anomalies, 1), 100.0), 4)::DOUBLE AS critical_pct,
       round(least(100.0 * high / greatest(total_anomalies, 1), 100.0), 4)::DOUBLE AS high_pct,
       round(least(100.0 * medium / greatest(total_anomalies, 1), 100.0), 4)::DOUBLE AS medium_pct FROM ({HEALTH})"""))(
    lambda spark, d: D.severity_share(D.health_summary(ensemble_rows(spark, d).withColumn("day", day()), "day")).select(
        "day", *[F.round(c, 4).alias(c) for c in ("critical_pct", "high_pct", "medium_pct")])
)
query("worst_entity", sql("tel", """
SELECT epoch_us(ts) // 86400000000 AS day,
       max_by(entity_id, {'v': value, 'e': entity_id}) FILTER (metric = 'utilization_pct') AS worst_link,
       round(max(value) FILTER (metric = 'utilization_pct'), 4) AS worst_link_utilization_pct,
       max_by(entity_id, {'v': value, 'e': entity_id}) FILTER (metric = 'cpu_pct') AS worst_node,
       round(max(value) FILTER (metric = 'cpu_pct'), 4) AS worst_node_cpu_pct,
       count(DISTINCT entity_id) FILTER (entity_type = 'node') AS total_nodes, count(DISTINCT entity_id) FILTER (entity_type = 'link') AS total_links
FROM tel GROUP BY 1"""))(
    lambda spark, d: D.worst_entities(T.telemetry(spark, d).withColumn("day", day()), "day")
)
query("most_severe", sql("ens", f"""
SELECT entity_id, b.metric AS metric, b.severity AS severity, b.confidence AS confidence, b.t AS ts_us FROM (
  SELECT entity_id, max_by({{'metric': metric, 'severity': severity, 'confidence': confidence, 't': epoch_us(ts)}},
         {{'r': {RANK.format('severity')}, 't': -epoch_us(ts), 's': -seq}}) AS b FROM ens GROUP BY 1)"""))(
    lambda spark, d: D.most_severe(ensemble_rows(spark, d), ["entity_id"]).select("entity_id", "metric", "severity", "confidence", micros())
)
query("anomaly_order", sql("ens", f"""
SELECT entity_id, metric, severity, confidence, epoch_us(ts) AS ts_us FROM ens
ORDER BY {RANK.format('severity')} DESC, confidence DESC, entity_id, metric"""))(
    lambda spark, d: D.by_severity(ensemble_rows(spark, d)).select("entity_id", "metric", "severity", "confidence", micros())
)

LAST = """
SELECT entity_id, metric, list(value ORDER BY ts, seq) AS vals, max(ts) AS ts FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, metric ORDER BY ts DESC, seq DESC) AS rn FROM tel
  WHERE metric IN ('utilization_pct', 'cpu_pct', 'memory_pct', 'temperature_c')) WHERE rn <= 60 GROUP BY ALL"""
TREND = f"""
SELECT *, list_transform(range(1, 11), lambda i: round(lvl + slope * i, 4)) AS p, CASE metric WHEN 'cpu_pct' THEN 90.0::DOUBLE ELSE 85.0::DOUBLE END AS lim FROM (
  SELECT entity_id, metric, ts, list_reduce(vals, lambda a, x: a + (x - a) * (2.0::DOUBLE / 11)) AS lvl,
         CASE WHEN len(tail) >= 2 THEN least(greatest(
           (list_sum(list_transform(tail, lambda y, i: y * (i - 1))) - (len(tail) - 1) / 2.0::DOUBLE * list_sum(tail))
             / (len(tail) * (len(tail) * len(tail) - 1) / 12.0::DOUBLE), -2.0::DOUBLE), 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS slope
  FROM (SELECT *, vals[greatest(len(vals) - 9, 1):] AS tail FROM ({LAST})))"""
FORECAST = f"""
SELECT *, list_max(p) AS peak, list_filter(list_transform(p, lambda v, i: CASE WHEN v >= lim THEN i END), lambda i: i IS NOT NULL)[1] AS minutes FROM ({TREND})"""
CONF = f"""
SELECT *, round(least(greatest(0.45::DOUBLE + least(greatest(0, (peak - lim) / greatest(lim, 1.0)), 0.5) * 0.5
  + greatest(0, 1 - least(list_stddev_pop(p) / 15, 1)) * 0.25 + CASE WHEN coalesce(minutes, 10) <= 3 THEN 1.0 WHEN coalesce(minutes, 10) <= 6 THEN 0.75 ELSE 0.5 END * 0.2
  - 0.15, 0), 0.95), 4)::DOUBLE AS confidence FROM ({FORECAST})"""


query("forecast_congestion", sql("tel", f"""
SELECT entity_id, metric, round(lvl, 6) AS level, round(slope, 6) AS slope, round(peak, 4) AS peak, minutes IS NOT NULL AS will_congest, minutes::DOUBLE AS minutes_until FROM ({FORECAST})"""))(
    lambda spark, d: FC.forecast_trend(T.telemetry(spark, d)).select(
        "entity_id", "metric", F.round("level", 6).alias("level"), F.round("slope", 6).alias("slope"), F.round("peak", 4).alias("peak"),
        "will_congest", F.col("minutes_until").cast("double").alias("minutes_until"))
)
query("forecast_confidence", sql("tel", f"""
SELECT entity_id, metric, epoch_us(ts) AS ts_us, round(peak, 4) AS observed, lim AS expected, confidence,
       CASE WHEN peak / lim >= 1.25 THEN 'critical' WHEN peak / lim >= 1.1 THEN 'high' ELSE 'medium' END AS severity FROM ({CONF}) WHERE minutes IS NOT NULL"""))(
    lambda spark, d: FC.predicted_anomalies(FC.forecast_trend(T.telemetry(spark, d))).select(
        "entity_id", "metric", micros(), F.round("observed", 4).alias("observed"), "expected", "confidence", "severity")
)

PRIORITY = f"""
SELECT entity_id, metric, b.severity AS severity, b.confidence AS confidence, b.detector AS detector FROM (
  SELECT entity_id, metric, max_by({{'severity': severity, 'confidence': confidence, 'detector': detector}},
         {{'p': priority, 'r': {RANK.format('severity')}, 'c': confidence, 's': seq}}) AS b FROM (
    SELECT entity_id, metric, severity, confidence, detector, seq, 1 AS priority FROM ens
    UNION ALL SELECT entity_id, metric, CASE WHEN peak / lim >= 1.25 THEN 'critical' WHEN peak / lim >= 1.1 THEN 'high' ELSE 'medium' END,
           confidence, 'forecast_predicted', 0, 0 FROM ({CONF}) WHERE minutes IS NOT NULL) GROUP BY ALL)"""


@query("priority_merge", sql("ens tel", PRIORITY))
def priority_merge(spark, d):
    names = ["entity_id", "metric", "severity", "confidence", "detector", "seq"]
    predicted = FC.predicted_anomalies(FC.forecast_trend(T.telemetry(spark, d))).select(names)
    return D.merge_predicted(ensemble_rows(spark, d).select(names), predicted, ["entity_id", "metric"]).drop("seq")


EVERY = """
SELECT entity_id, metric, ts, list(value) OVER (PARTITION BY entity_id, metric ORDER BY ts, seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS vals FROM tel
  WHERE metric IN ('utilization_pct', 'cpu_pct', 'memory_pct', 'temperature_c')"""
ROLLING = f"""
SELECT epoch_us(ts) AS ts_us, entity_id, metric, round(peak, 6) AS observed, lim AS expected, confidence,
       CASE WHEN peak / lim >= 1.25 THEN 'critical' WHEN peak / lim >= 1.1 THEN 'high' ELSE 'medium' END AS severity
FROM ({CONF.replace(LAST, EVERY)}) WHERE minutes IS NOT NULL"""


@query("rolling_forecasts", sql("tel", ROLLING))
def rolling_forecasts(spark, d):
    """Predicted anomalies at every reading, from the 60 readings up to it."""
    return shown(rolling_predictions(T.telemetry(spark, d)))


@query("linear_forecast")
def linear_forecast(spark, d):
    """One forecast per nation's link metric: the user links of a nation are read as one series, long enough to learn from."""
    long = T.telemetry(spark, d).where("entity_type = 'link'")
    series = long.select("ts", F.substring_index("entity_id", "-", 1).alias("entity_id"), "metric", "value", "seq")
    return FC.forecast_linear(series, FC.fit_linear(series)).select(
        "entity_id", "metric", "peak", "will_congest", "minutes_until", "confidence", "uncertainty", "high_uncertainty"
    )


AHEAD = 3
SERIES_FORECAST = f"""
WITH s AS (SELECT entity_id, metric, ts, seq, min(value) OVER k AS lo, max(value) OVER k - min(value) OVER k AS span, value FROM tel WINDOW k AS (PARTITION BY entity_id, metric)),
z AS (SELECT *, (value - lo) / CASE WHEN span = 0 THEN 1.0::DOUBLE ELSE span END AS x FROM s),
w AS (SELECT *, {", ".join(f"lead(x, {h}) OVER o AS y{h}" for h in range(1, AHEAD + 1))}, row_number() OVER (PARTITION BY entity_id, metric ORDER BY ts DESC, seq DESC) AS newest
      FROM z WINDOW o AS (PARTITION BY entity_id, metric ORDER BY ts, seq)),
own AS (SELECT entity_id, metric, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, {", ".join(f"sum(y{h}) AS b{h}, sum(x * y{h}) AS c{h}" for h in range(1, AHEAD + 1))}
        FROM w WHERE y{AHEAD} IS NOT NULL GROUP BY ALL),
pool AS (SELECT 30.0::DOUBLE / sum(n) AS k, sum(sx) AS psx, sum(sxx) AS psxx, {", ".join(f"sum(b{h}) AS p{h}, sum(c{h}) AS q{h}" for h in range(1, AHEAD + 1))} FROM own),
a AS (SELECT w.entity_id, w.metric, w.x, w.lo, CASE WHEN w.span = 0 THEN 1.0::DOUBLE ELSE w.span END AS span, CASE w.metric WHEN 'cpu_pct' THEN 90.0::DOUBLE ELSE 85.0::DOUBLE END AS lim,
             coalesce(own.n, 0) AS windows, coalesce(own.n, 0) + 30.001::DOUBLE AS a0, coalesce(sx, 0) + k * psx AS a1, coalesce(sxx, 0) + k * psxx + 0.001::DOUBLE AS a2,
             {", ".join(f"coalesce(b{h}, 0) + k * p{h} AS d{h}, coalesce(c{h}, 0) + k * q{h} AS e{h}" for h in range(1, AHEAD + 1))}
      FROM w LEFT JOIN own USING (entity_id, metric), pool WHERE newest = 1),
f AS (SELECT *, [{", ".join(f"round(((d{h} * a2 - e{h} * a1) + (a0 * e{h} - a1 * d{h}) * x) / (a0 * a2 - a1 * a1) * span + lo, 4)" for h in range(1, AHEAD + 1))}] AS p FROM a)
SELECT entity_id, metric, windows::BIGINT AS windows, round(list_max(p), 3) AS peak, list_max(p) >= lim AS will_congest FROM f"""


@query("series_forecast", sql("tel", SERIES_FORECAST))
def series_forecast(spark, d):
    """A forecast of the next readings of every entity's metric, each by its own fit shrunk towards the common one."""
    long = T.telemetry(spark, d)
    sums = FC.series_sums(long, lags=1, ahead=AHEAD)
    return FC.forecast_series(long, sums, lags=1, ahead=AHEAD).select("entity_id", "metric", "windows", F.round("peak", 3).alias("peak"), "will_congest")


@query("iforest_scores")
def iforest_scores(spark, d):
    long = T.telemetry(spark, d)
    steps = IF.fit_forest(long)
    scored = IF.score_forest(long, steps)
    return shown(IF.forest_hits(scored, IF.forest_offsets(scored), steps.select("metric", "median")))


RULES = ("utilization_pct", "latency_ms", "packet_loss_pct", "cpu_pct")


@query("graph_violation_scores", sql("utel", """
SELECT day, entity_id, least(1.0, v / 4.0)::DOUBLE AS score, v / 4.0 >= 0.6 AS anomalous FROM (
  SELECT epoch_us(ts) // 86400000000 AS day, entity_id,
         (coalesce(max(value) FILTER (metric = 'utilization_pct'), 0) > 85)::INT + (coalesce(max(value) FILTER (metric = 'latency_ms'), 0) > 50)::INT
       + (coalesce(max(value) FILTER (metric = 'packet_loss_pct'), 0) > 1)::INT AS v FROM utel GROUP BY ALL)"""))
def graph_violation_scores(spark, d):
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
    wide = T.user_telemetry(spark, d).withColumn("day", day()).groupBy("day", "entity_id").agg(*[pick(m) for m in RULES])
    return G.violation_scores(wide).select("day", "entity_id", "score", "anomalous")


@query("graph_conv_scores")
def graph_conv_scores(spark, d):
    long = T.user_telemetry(spark, d).withColumn("day", day())
    features = node_features(long, T.nodes(spark, d), None, RULES, "day")
    links = T.links(spark, d)
    model = G.fit_graph_score(features, links, RULES, "day")
    scores = G.graph_scores(model, features, links, RULES, "day")
    return G.graph_anomalies(scores, "day").withColumn("observed", F.round("observed", 3)).withColumn("confidence", F.round("confidence", 3))


query("node_features", sql("utel nodes", """
SELECT epoch_us(ts) // 86400000000 AS day, entity_id, coalesce(max(value) FILTER (metric = 'cpu_pct'), 0)::DOUBLE AS cpu_pct, 0.0::DOUBLE AS memory_pct,
       0.0::DOUBLE AS temperature_c, 0.0::DOUBLE AS buffer_drops, (coalesce(max(value) FILTER (metric = 'cpu_pct'), 0) > 85)::INT AS label
FROM utel WHERE entity_id IN (SELECT node_id FROM nodes) GROUP BY ALL"""))(
    lambda spark, d: node_features(T.user_telemetry(spark, d).withColumn("day", day()), T.nodes(spark, d), None, NODE_METRICS, "day")
)
query("latency_baselines", sql("tel links", """
SELECT coalesce(l.link_id, m.entity_id) AS entity_id, round(coalesce(m.b, l.latency_baseline_ms), 6) AS baseline_ms FROM links l
FULL JOIN (SELECT entity_id, avg(value) AS b FROM tel WHERE metric = 'latency_ms' GROUP BY 1) m ON m.entity_id = l.link_id"""))(
    lambda spark, d: D.latency_baselines(T.links(spark, d), D.baselines(T.telemetry(spark, d))).withColumn("baseline_ms", F.round("baseline_ms", 6))
)


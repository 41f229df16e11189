"""Topology, joins with it, causal graph and root-cause queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwarden.contract.detection import day, ensemble_rows, micros, threshold_rows
from tickwarden.contract.registry import RANK, query, sql
from tickwarden.functions import ids as I
from tickwarden.operators import causal as C
from tickwarden.operators import context as X
from tickwarden.operators import evaluation as EV
from tickwarden.operators import paths as P
from tickwarden.operators import topology as TP
from tickwarden.operators.intervals import before_during, label_times
from tickwarden.sources import io
from tickwarden.sources import tables as T


def util(spark, d):
    return T.state(spark, d).where("metric = 'utilization_pct'").select(F.col("entity_id").alias("link_id"), "value")


def incidents(spark, d, first=None):
    """Threshold anomalies inside each scenario window."""
    return EV.scenario_anomalies(threshold_rows(spark, d), T.scenarios(spark, d), first)


def graph(spark, d):
    return C.structural_graph(T.nodes(spark, d), T.links(spark, d))


# -- topology ----------------------------------------------------------------------------------------------------

query("topology_links", sql("links", "SELECT link_id, source, target, capacity_gbps, latency_baseline_ms FROM links"))(
    lambda spark, d: io.topology_tables(T.nodes(spark, d), TP.both_directions(T.links(spark, d)).where("source < target").drop("weight"))[1].join(
        T.links(spark, d).select("link_id", F.col("source").alias("s"), F.col("target").alias("t")), "link_id"
    ).select("link_id", F.col("s").alias("source"), F.col("t").alias("target"), "capacity_gbps", "latency_baseline_ms")
)
query("topology_totals", sql("nodes links", """
SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM links) AS total_links,
       (SELECT sum(customers)::BIGINT FROM nodes) AS total_customers, (SELECT sum(capacity_gbps) FROM links) AS total_capacity_gbps"""))(
    lambda spark, d: TP.totals(T.nodes(spark, d), T.links(spark, d))
)
query("link_direction", sql("links nodes", """
SELECT link_id, CASE WHEN a.tier <= b.tier THEN source ELSE target END AS upstream, CASE WHEN a.tier <= b.tier THEN target ELSE source END AS downstream
FROM links JOIN (SELECT node_id, CASE node_type WHEN 'core' THEN 1 WHEN 'aggregation' THEN 2 ELSE 3 END AS tier FROM nodes) a ON a.node_id = source
JOIN (SELECT node_id, CASE node_type WHEN 'core' THEN 1 WHEN 'aggregation' THEN 2 ELSE 3 END AS tier FROM nodes) b ON b.node_id = target"""))(
    lambda spark, d: TP.directed_links(T.links(spark, d), T.nodes(spark, d)).select("link_id", "upstream", "downstream")
)
query("neighbour_mean", sql("nodes inc util", """
SELECT n.node_id, round(coalesce(avg(u.value), 50.0), 6)::DOUBLE AS mean_utilization FROM nodes n
LEFT JOIN inc i ON i.node_id = n.node_id LEFT JOIN util u ON u.link_id = i.link_id GROUP BY 1"""))(
    lambda spark, d: TP.neighbor_mean(T.links(spark, d), T.nodes(spark, d), util(spark, d)).withColumn("mean_utilization", F.round("mean_utilization", 6))
)
query("colocated_counts", sql("inc", """
SELECT a.link_id, count(*) AS co_located FROM inc a JOIN inc b ON a.node_id = b.node_id AND a.link_id <> b.link_id GROUP BY 1"""))(
    lambda spark, d: TP.colocation_counts(T.links(spark, d)).where("co_located > 0")
)
query("sibling_links", sql("inc scen", """
SELECT DISTINCT a.link_id AS target_link, b.link_id FROM inc a JOIN inc b ON a.node_id = b.node_id AND a.link_id <> b.link_id
WHERE a.link_id IN (SELECT l FROM scen WHERE NOT on_node)"""))(
    lambda spark, d: TP.sibling_links(
        T.scenarios(spark, d).where("root_cause_link IS NOT NULL").select(F.col("root_cause_link").alias("link_id")), T.links(spark, d)
    )
)
query("sibling_load", sql("inc util", """
SELECT a.link_id, count(*) AS siblings, round(avg(u.value), 6) AS mean_sibling_utilization FROM inc a
JOIN inc b ON a.node_id = b.node_id AND a.link_id <> b.link_id LEFT JOIN util u ON u.link_id = b.link_id GROUP BY 1"""))(
    lambda spark, d: TP.sibling_load(T.links(spark, d), util(spark, d)).withColumn("mean_sibling_utilization", F.round("mean_sibling_utilization", 6)).where("siblings > 0")
)
query("attached_links", sql("inc scen", """
SELECT s.scenario_id, i.node_id, i.link_id FROM scen s JOIN inc i ON i.node_id = s.u WHERE s.on_node"""))(
    lambda spark, d: TP.attached_links(
        T.scenarios(spark, d).where("root_cause_node IS NOT NULL").select("scenario_id", F.col("root_cause_node").alias("node_id")), T.links(spark, d)
    ).select("scenario_id", "node_id", "link_id")
)
ALTERNATE = """SELECT l.link_id, min(i.link_id) FILTER (i.link_id <> l.link_id) AS alternate
FROM links l JOIN inc i ON i.node_id = split_part(l.link_id, '-', 1) GROUP BY 1"""
query("alternate_link", sql("links inc", ALTERNATE))(lambda spark, d: TP.alternate_link(T.links(spark, d)))
query("link_capacity", sql("state links", """
SELECT entity_id, coalesce(l.capacity_gbps, 100.0)::DOUBLE AS capacity_gbps, round(value / 100 * coalesce(l.capacity_gbps, 100.0), 6)::DOUBLE AS used_gbps
FROM state s LEFT JOIN links l ON l.link_id = s.entity_id WHERE metric = 'utilization_pct'"""))(
    lambda spark, d: TP.link_capacity(T.state(spark, d).where("metric = 'utilization_pct'").select("entity_id", "value"), T.links(spark, d), "entity_id").select(
        "entity_id", "capacity_gbps", F.round(F.col("value") / 100 * F.col("capacity_gbps"), 6).alias("used_gbps"))
)


def scenario_entities(spark, d):
    return T.scenarios(spark, d).select("scenario_id", F.explode(F.concat("affected_nodes", "affected_links")).alias("entity_id"))


query("customer_impact", sql("scen nodes", """
WITH hit AS (SELECT DISTINCT scenario_id, unnest([u, n]) AS node_id FROM scen)
SELECT scenario_id, sum(customers)::BIGINT AS customers, round(least(1.0, sum(customers) / (SELECT sum(customers) FROM nodes)), 8)::DOUBLE AS impact
FROM hit JOIN nodes USING (node_id) GROUP BY 1"""))(
    lambda spark, d: TP.customer_impact(scenario_entities(spark, d), T.nodes(spark, d), "scenario_id").withColumn("impact", F.round("impact", 8))
)
query("target_regions", sql("scen nodes", """
SELECT DISTINCT scenario_id, region FROM (SELECT scenario_id, unnest([u, n]) AS node_id FROM scen) JOIN nodes USING (node_id)"""))(
    lambda spark, d: TP.target_regions(scenario_entities(spark, d), T.nodes(spark, d), "scenario_id")
)
query("kill_switch_filter", sql("scen nodes", """
SELECT scenario_id FROM scen WHERE scenario_id NOT IN (SELECT scenario_id FROM (SELECT scenario_id, unnest([u, n]) AS node_id FROM scen) JOIN nodes USING (node_id)
WHERE region IN (SELECT min(r_name) FROM region))"""))(
    lambda spark, d: TP.not_blocked(
        T.scenarios(spark, d).select("scenario_id"), TP.target_regions(scenario_entities(spark, d), T.nodes(spark, d), "scenario_id"),
        [T.table(spark, d, "region").agg(F.min("r_name")).first()[0]], "scenario_id")
)

# -- paths -------------------------------------------------------------------------------------------------------

WALK = """WITH arc AS (SELECT source AS a, target AS b FROM links UNION ALL SELECT target, source FROM links),
deg AS (SELECT a, count(*) AS k FROM arc GROUP BY 1),
want AS ({want}),
walk AS (
  SELECT source, target, source AS node, [source] AS path FROM want
  UNION ALL
  SELECT w.source, w.target, arc.b, list_append(w.path, arc.b) FROM walk w JOIN arc ON arc.a = w.node JOIN deg ON deg.a = arc.b
  WHERE w.node <> w.target AND len(w.path) <= {hops} AND NOT list_contains(w.path, arc.b) AND (deg.k > 1 OR arc.b = w.target))
"""
PAIRS = "SELECT DISTINCT u AS source, 'R0' AS target FROM scen"
query("shortest_path", sql("links scen", WALK.format(want=PAIRS, hops=5) + """
SELECT source, target, cost, cost::INT AS hops, path FROM (
  SELECT source, target, (len(path) - 1)::DOUBLE AS cost, array_to_string(path, '>') AS path,
         row_number() OVER (PARTITION BY source, target ORDER BY len(path), array_to_string(path, '>')) AS rn FROM walk WHERE node = target) WHERE rn = 1""", recursive=True))(
    lambda spark, d: P.shortest_paths(
        T.links(spark, d), T.scenarios(spark, d).select(F.element_at("affected_nodes", -1).alias("source"), F.lit("R0").alias("target")))
)
query("simple_path_count", sql("links", WALK.format(want="SELECT source, target FROM links", hops=4) + """
SELECT source, target, count(*) FILTER (node = target) AS paths FROM walk GROUP BY 1, 2""", recursive=True))(
    lambda spark, d: P.path_counts(T.links(spark, d), T.links(spark, d).select("source", "target"), 4)
)
query("neighbour_lists", sql("inc scen", """
SELECT node_id, array_to_string(list(DISTINCT neighbor ORDER BY neighbor), ',') AS neighbors FROM inc WHERE node_id IN (SELECT u FROM scen UNION SELECT n FROM scen) GROUP BY 1"""))(
    lambda spark, d: TP.neighbor_lists(
        T.links(spark, d), T.scenarios(spark, d).select(F.explode(F.split(F.element_at("affected_links", 1), "-")).alias("node_id"))
    ).withColumn("neighbors", F.array_join("neighbors", ","))
)

# -- windows of time ---------------------------------------------------------------------------------------------

TRUTH = """
SELECT t.ts, count(s.scenario_id) > 0 AS is_anomaly,
       max_by({'id': s.scenario_id, 'k': s.scenario_type, 'v': s.severity}, {'r': s.rank, 't': -epoch_us(s.start_time), 's': s.scenario_id}) FILTER (s.scenario_id IS NOT NULL) AS b
FROM (SELECT DISTINCT ts FROM events) t LEFT JOIN scen s ON t.ts >= s.start_time AND t.ts <= s.end_time GROUP BY 1"""
query("ground_truth_labels", sql("scen", f"""
SELECT epoch_us(ts) AS ts_us, is_anomaly, b.id AS scenario_id, b.k AS scenario_type, b.v AS severity FROM ({TRUTH})"""))(
    lambda spark, d: label_times(T.table(spark, d, "events"), T.scenarios(spark, d)).select(micros(), "is_anomaly", "scenario_id", "scenario_type", "severity")
)


def truth(spark, d):
    return label_times(T.table(spark, d, "events"), T.scenarios(spark, d))


query("detection_confusion", sql("scen thr", f"""
SELECT tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4)::DOUBLE AS f1 FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS r FROM (
    SELECT count(*) FILTER (is_anomaly AND h) AS tp, count(*) FILTER (NOT is_anomaly AND h) AS fp, count(*) FILTER (is_anomaly AND NOT h) AS fn,
           count(*) FILTER (NOT is_anomaly AND NOT h) AS tn
    FROM (SELECT is_anomaly, ts IN (SELECT ts FROM thr) AS h FROM ({TRUTH}))))"""))(
    lambda spark, d: EV.confusion(truth(spark, d), threshold_rows(spark, d))
)
DELAY = """
SELECT s.scenario_id, s.scenario_type, min(a.ts) IS NOT NULL AS detected, round((epoch_us(min(a.ts)) - epoch_us(any_value(s.start_time))) / 1e6, 1) AS mttd_seconds
FROM scen s LEFT JOIN (SELECT DISTINCT ts FROM thr) a ON a.ts >= s.start_time AND a.ts <= s.end_time GROUP BY 1, 2"""


def delays(spark, d):
    return EV.time_to_detect(threshold_rows(spark, d), T.scenarios(spark, d))


query("time_to_detect", sql("scen thr", DELAY))(delays)
query("mean_time_to_detect", sql("scen thr", f"""
SELECT round(avg(mttd_seconds), 1) AS mean_mttd_seconds, count(*) FILTER (detected) AS scenarios_detected, count(*) AS scenarios_total FROM ({DELAY})"""))(
    lambda spark, d: EV.mean_time_to_detect(delays(spark, d))
)
DECIDED = f"""
SELECT scenario_id, scenario_type, detected,
       CASE WHEN detected THEN CASE scenario_type WHEN 'congestion_cascade' THEN 'reroute_traffic' WHEN 'hardware_degradation' THEN 'failover_node'
            WHEN 'ddos_surge' THEN 'rate_limit_flow' WHEN 'misconfiguration' THEN 'rollback_config' ELSE 'activate_backup_path' END END AS decision,
       CASE WHEN detected THEN CASE scenario_type WHEN 'ddos_surge' THEN 'AUTOMATIC' WHEN 'hardware_degradation' THEN 'HUMAN_APPROVAL'
            WHEN 'fiber_cut' THEN 'HUMAN_APPROVAL' ELSE 'AUTOMATIC_CANARY' END END AS autonomy_level,
       CASE WHEN detected THEN CASE scenario_type WHEN 'congestion_cascade' THEN 45.0 WHEN 'hardware_degradation' THEN 120.0 WHEN 'ddos_surge' THEN 30.0
            WHEN 'misconfiguration' THEN 60.0 ELSE 90.0 END END::DOUBLE AS mttm_seconds,
       detected AND scenario_type NOT IN ('hardware_degradation', 'fiber_cut') AS verified FROM ({DELAY})"""
query("decision_table", sql("scen thr", DECIDED))(lambda spark, d: EV.decisions(delays(spark, d)).withColumn("verified", F.coalesce("verified", F.lit(False))))
query("decision_summary", sql("scen thr", f"""
SELECT round(avg(mttm_seconds), 1) AS mean_mttm_seconds, round(count(*) FILTER (verified) / count(*) FILTER (detected), 4) AS pass_rate FROM ({DECIDED})"""))(
    lambda spark, d: EV.decision_summary(EV.decisions(delays(spark, d)))
)
query("before_during", sql("scen tel", """
SELECT scenario_id, metric, round(avg(value) FILTER (t.ts < start_time), 6) AS before, round(avg(value) FILTER (t.ts >= start_time), 6) AS during, count(*) AS n
FROM (SELECT scenario_id, start_time, end_time, unnest(CASE WHEN on_node THEN [u, l] ELSE [n, u, l] END) AS entity_id FROM scen) s
JOIN tel t ON t.entity_id = s.entity_id AND t.ts >= s.start_time - INTERVAL 86400 SECOND AND t.ts <= s.end_time GROUP BY 1, 2"""))(
    lambda spark, d: before_during(T.telemetry(spark, d), T.scenarios(spark, d), 86400).withColumns(
        {"before": F.round("before", 6), "during": F.round("during", 6)})
)
query("scenario_table", sql("scen", """
SELECT scenario_id, scenario_type, severity, 45::BIGINT AS duration_min, CASE WHEN on_node THEN u ELSE '' END AS root_cause_node,
       CASE WHEN on_node THEN '' ELSE l END AS root_cause_link, CASE WHEN on_node THEN 1 ELSE 2 END AS n_affected_nodes, 1 AS n_affected_links FROM scen"""))(
    lambda spark, d: EV.scenario_table(T.scenarios(spark, d))
)

# -- causal graph ------------------------------------------------------------------------------------------------

SHORT = "CASE {0} WHEN 'utilization_pct' THEN 'utilization' WHEN 'latency_ms' THEN 'latency' WHEN 'packet_loss_pct' THEN 'packet_loss' WHEN 'throughput_gbps' THEN 'throughput' ELSE 'cpu' END"
EDGES = """
SELECT src, dst, max(strength)::DOUBLE AS strength FROM (
  SELECT link_id || '_utilization' AS src, link_id || '_packet_loss' AS dst, 0.75 AS strength FROM links
  UNION ALL SELECT link_id || '_utilization', link_id || '_latency', 0.65 FROM links
  UNION ALL SELECT link_id || '_utilization', down || '_latency', 0.60 FROM dirs
  UNION ALL SELECT link_id || '_packet_loss', down || '_latency', 0.50 FROM dirs
  UNION ALL SELECT node_id || '_cpu', node_id || '_temperature', 0.70 FROM nodes
  UNION ALL SELECT node_id || '_temperature', node_id || '_buffer_drops', 0.65 FROM nodes
  UNION ALL SELECT node_id || '_cpu', node_id || '_buffer_drops', 0.55 FROM nodes
  UNION ALL SELECT node_id || '_memory', node_id || '_buffer_drops', 0.45 FROM nodes
  UNION ALL SELECT a.link_id || '_utilization', b.link_id || '_utilization', 0.40 FROM inc a JOIN inc b ON a.node_id = b.node_id AND a.link_id <> b.link_id)
GROUP BY 1, 2"""
DIRS = """dirs AS (SELECT link_id, CASE WHEN substr(source, 1, 1) = 'R' AND substr(target, 1, 1) <> 'U' THEN target
  WHEN substr(source, 1, 1) = 'N' THEN target ELSE target END AS down FROM links)"""
GRAPH = f"{DIRS}, edges AS ({EDGES})"


@query("structural_edges", sql("links nodes inc", f"WITH {GRAPH} SELECT src, dst, strength, 'structural' AS edge_type FROM edges"))
def structural_edges(spark, d):
    return graph(spark, d).cut().all_edges()


GRID = """grid AS (SELECT metric AS variable, epoch_us(ts) // 21600000000 AS t, avg(value) AS value FROM tel GROUP BY ALL)"""
STATS = """stats AS (SELECT a.variable AS src, b.variable AS dst, k AS lag, corr(a.value, b.value) AS r, count(*) AS n
  FROM grid a, range(1, 6) r(k), grid b WHERE b.t = a.t + k AND a.variable <> b.variable GROUP BY ALL),
best AS (SELECT src, dst, b.r AS r, b.lag AS lag, b.n AS n FROM (SELECT src, dst, max_by({'r': r, 'lag': lag, 'n': n}, {'a': round(abs(r), 12), 'l': -lag}) AS b
  FROM stats WHERE n >= 10 AND NOT isnan(r) GROUP BY 1, 2))"""


def grid(spark, d):
    """Six-hour means per metric over the whole network."""
    return T.telemetry(spark, d).groupBy(F.col("metric").alias("variable"), F.floor(F.unix_seconds("ts") / 21600).alias("t")).agg(F.avg("value").alias("value"))


def metric_pairs(spark):
    names = sorted(T.EVENT_METRIC.values())
    return spark.createDataFrame([(a, b) for a in names for b in names if a != b], "src string, dst string")


query("lagged_correlation", sql("tel", f"WITH {GRID}, {STATS} SELECT src, dst, lag::INT AS lag, round(r, 6) AS r, n FROM best"))(
    lambda spark, d: C.best_lag(C.lagged_stats(grid(spark, d), metric_pairs(spark))).select("src", "dst", "lag", F.round("r", 6).alias("r"), "n")
)
query("criterion_edges", sql("tel", f"""WITH {GRID}, {STATS}, fit AS (SELECT * FROM best WHERE n * ln(1 - r * r) + ln(n) < 0)
SELECT a.src, a.dst, 0.70::DOUBLE AS strength, 'learned' AS edge_type FROM fit a LEFT JOIN fit b ON a.src = b.dst AND a.dst = b.src
WHERE b.src IS NULL OR abs(a.r) > abs(b.r) OR (abs(a.r) = abs(b.r) AND a.src < a.dst)"""))(
    lambda spark, d: C.criterion_edges(C.lagged_stats(grid(spark, d), metric_pairs(spark)))
)
NGRID = f"""ngrid AS (SELECT entity_id, entity_id || '_' || {SHORT.format('metric')} AS variable, epoch_us(ts) // 86400000000 AS t, avg(value) AS value FROM utel GROUP BY ALL),
nstats AS (SELECT a.variable AS src, b.variable AS dst, k AS lag, corr(a.value, b.value) AS r, count(*) AS n
  FROM ngrid a, range(1, 6) r(k), ngrid b WHERE b.t = a.t + k AND a.entity_id = b.entity_id AND a.variable <> b.variable GROUP BY ALL),
nbest AS (SELECT src, dst, b.r AS r, b.lag AS lag FROM (SELECT src, dst, max_by({{'r': r, 'lag': lag}}, {{'a': round(abs(r), 12), 'l': -lag}}) AS b
  FROM nstats WHERE n >= 10 AND NOT isnan(r) GROUP BY 1, 2)),
learned AS (SELECT src, dst, round(r, 4) AS strength FROM nbest WHERE r >= 0.6)"""


def learned(spark, d):
    """Edges between the metrics of one user, from daily means; only such pairs are joined."""
    names = ("cpu", "latency", "packet_loss", "throughput", "utilization")
    rows = T.user_telemetry(spark, d).select(
        "entity_id", I.variable(F.col("entity_id"), F.col("metric")).alias("variable"), F.col("value"), day().alias("t")
    ).groupBy("entity_id", "variable", "t").agg(F.avg("value").alias("value"))
    users = T.user_telemetry(spark, d).select("entity_id").distinct()
    both = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in names for b in names if a != b])
    pairs = users.select("entity_id", F.inline(both)).select(
        F.concat_ws("_", "entity_id", "a").alias("src"), F.concat_ws("_", "entity_id", "b").alias("dst")
    )
    return C.lagged_edges(rows, pairs)


query("lagged_correlation_edges", sql("utel", f"WITH {NGRID} SELECT src, dst, strength, 'learned' AS edge_type FROM learned"))(learned)
UNION = f"""{GRAPH}, {NGRID}, merged AS (SELECT coalesce(s.src, l.src) AS src, coalesce(s.dst, l.dst) AS dst, greatest(s.strength, l.strength) AS strength,
  CASE WHEN s.src IS NULL THEN 'learned' WHEN l.strength > s.strength THEN 'both' ELSE 'structural' END AS edge_type
  FROM edges s FULL JOIN learned l ON s.src = l.src AND s.dst = l.dst)"""


def merged(spark, d):
    return C.union_graph(graph(spark, d).cut(), learned(spark, d)).all_edges()


query("graph_union", sql("links nodes inc utel", f"WITH {UNION} SELECT * FROM merged"))(merged)
query("graph_summary", sql("links nodes inc utel", f"""WITH {UNION}
SELECT count(*) AS num_edges, count(*) FILTER (edge_type IN ('structural', 'both')) AS structural_edges, count(*) FILTER (edge_type IN ('learned', 'both')) AS learned_edges,
       (SELECT count(DISTINCT v) FROM (SELECT src AS v FROM merged UNION ALL SELECT dst FROM merged)) AS num_nodes FROM merged"""))(
    lambda spark, d: C.graph_summary(merged(spark, d))
)
query("strongest_edges", sql("links nodes inc utel", f"WITH {UNION} SELECT * FROM merged ORDER BY strength DESC, src, dst LIMIT 10"))(
    lambda spark, d: C.strongest_edges(merged(spark, d))
)

# -- search and root causes --------------------------------------------------------------------------------------

SEEN = f"""seen AS (SELECT incident_id, variable, b.ts AS ts, b.e AS entity_id, b.m AS metric FROM (
  SELECT s.scenario_id AS incident_id, t.entity_id || '_' || {SHORT.format('t.metric')} AS variable,
         max_by({{'ts': t.ts, 'e': t.entity_id, 'm': t.metric}}, {{'r': {RANK.format('t.severity')}, 't': -epoch_us(t.ts), 's': -t.seq}}) AS b
  FROM scen s JOIN thr t ON t.ts >= s.start_time AND t.ts <= s.end_time GROUP BY 1, 2)),
named AS (SELECT s.scenario_id AS incident_id, t.entity_id || '_' || {SHORT.format('t.metric')} AS candidate, min(t.ts) AS first_ts
  FROM scen s JOIN thr t ON t.ts >= s.start_time AND t.ts <= s.end_time GROUP BY 1, 2)"""


def search(hops: int = 4) -> str:
    parts = ["lvl0 AS (SELECT DISTINCT incident_id, variable AS seed, variable AS node, 0 AS hops, 1.0::DOUBLE AS strength, variable AS path FROM seen)"]
    for k in range(1, hops + 1):
        before = " UNION ALL ".join(f"SELECT incident_id, seed, node FROM lvl{i}" for i in range(k))
        parts.append(f"""lvl{k} AS MATERIALIZED (SELECT incident_id, seed, node, {k} AS hops, strength, path FROM (
  SELECT f.incident_id, f.seed, e.src AS node, f.strength * e.strength AS strength, e.src || '>' || f.path AS path,
         row_number() OVER (PARTITION BY f.incident_id, f.seed, e.src ORDER BY -round(f.strength * e.strength, 9), e.src || '>' || f.path) AS rn
  FROM lvl{k - 1} f JOIN edges e ON e.dst = f.node
  WHERE (f.incident_id, f.seed, e.src) NOT IN ({before})) WHERE rn = 1)""")
    every = " UNION ALL ".join(f"SELECT * FROM lvl{k}" for k in range(1, hops + 1))
    return ", ".join(parts) + f", reach AS ({every})"


SEARCH = f"{GRAPH}, {SEEN}, {search()}"


ROOT_SEARCH = f"{GRAPH}, seen AS (SELECT DISTINCT 0 AS incident_id, l || '_latency' AS variable FROM scen), {search()}"


@query("upstream_search", sql("links nodes inc scen", f"""WITH {ROOT_SEARCH}
SELECT seed, node, hops, round(strength, 6) AS strength, path FROM reach"""))
def upstream_search(spark, d):
    """What lies upstream of the latency of every incident's link."""
    seeds = T.scenarios(spark, d).select(F.explode("affected_links").alias("l")).select(F.concat("l", F.lit("_latency")).alias("seed"))
    return C.upstream(graph(spark, d), seeds).withColumn("strength", F.round("strength", 6))


def scored(keep: str) -> str:
    return f"""cand AS (SELECT r.incident_id, r.node AS candidate, avg(r.strength) AS st,
  avg(CASE WHEN n.first_ts IS NULL THEN 0.5 WHEN n.first_ts < s.ts THEN 0.9 WHEN n.first_ts = s.ts THEN 0.5 ELSE 0.2 END::DOUBLE) AS tp, count(DISTINCT r.seed) AS ex
  FROM reach r JOIN seen s ON s.incident_id = r.incident_id AND s.variable = r.seed LEFT JOIN named n ON n.incident_id = r.incident_id AND n.candidate = r.node
  WHERE {keep} GROUP BY 1, 2),
tot AS (SELECT incident_id, count(*) AS obs FROM seen GROUP BY 1),
score AS (SELECT c.*, obs, st * 0.45::DOUBLE + tp * 0.25::DOUBLE + ex / obs * 0.30::DOUBLE AS score FROM cand c JOIN tot USING (incident_id))"""


RANKED = """SELECT incident_id, rank::INT AS rank, candidate AS root_cause, round(least(score, 0.99), 4)::DOUBLE AS confidence, ex AS explained FROM (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY round(score, 9) DESC, candidate) AS rank FROM score) WHERE rank <= 5"""


# Incidents without a candidate: their most severe anomaly, the first on a tie.
FALLBACK = f"""
UNION ALL SELECT incident_id, 1, b, 0.42::DOUBLE, 1 FROM (
  SELECT s.scenario_id AS incident_id, max_by(t.entity_id || '_' || {SHORT.format('t.metric')}, {{'r': {RANK.format('t.severity')}, 't': -epoch_us(t.ts), 's': -t.seq}}) AS b
  FROM scen s JOIN thr t ON t.ts >= s.start_time AND t.ts <= s.end_time GROUP BY 1) WHERE incident_id NOT IN (SELECT incident_id FROM score)"""


def ranked(spark, d, observed):
    rows = C.root_causes(incidents(spark, d), graph(spark, d), allow_observed_roots=observed)
    return rows.select("incident_id", "rank", "root_cause", "confidence", F.size("evidence").cast("long").alias("explained"))


query("root_cause_rank", sql("links nodes inc scen thr", f"WITH {SEARCH}, {scored('true')} {RANKED}{FALLBACK}"))(lambda spark, d: ranked(spark, d, True))
query("root_cause_parity", sql("links nodes inc scen thr", f"""WITH {SEARCH}, {scored('(r.incident_id, r.node) NOT IN (SELECT incident_id, variable FROM seen)')} {RANKED}{FALLBACK}"""))(
    lambda spark, d: ranked(spark, d, False)
)


@query("top_hypotheses")
def top_hypotheses(spark, d):
    rows = C.top_hypotheses(C.root_causes(incidents(spark, d), graph(spark, d)))
    return rows.select("incident_id", "rank", "description", "root_cause", "confidence", F.array_join("evidence", "; ").alias("evidence"),
                       F.array_join("affected_nodes", ",").alias("affected_nodes"), F.array_join("affected_links", ",").alias("affected_links"))


@query("root_cause_accuracy")
def root_cause_accuracy(spark, d):
    """Per scenario: does the top hypothesis over its first 20 anomalies name the true root?"""
    return EV.root_cause_accuracy(threshold_rows(spark, d), T.scenarios(spark, d), graph(spark, d))


# -- context of an incident --------------------------------------------------------------------------------------

query("affected_state", sql("scen thr state", """
SELECT a.incident_id, s.entity_id, s.metric, s.value FROM (SELECT DISTINCT s.scenario_id AS incident_id, t.entity_id FROM scen s JOIN thr t ON t.ts >= s.start_time AND t.ts <= s.end_time) a
JOIN state s ON s.entity_id = a.entity_id"""))(
    lambda spark, d: X.affected_state(incidents(spark, d), T.state(spark, d)).select("incident_id", "entity_id", "metric", "value")
)
query("affected_neighbours", sql("scen thr inc", """
WITH touched AS (SELECT DISTINCT s.scenario_id AS incident_id, unnest(CASE WHEN contains(t.entity_id, '-') THEN string_split(t.entity_id, '-') ELSE [t.entity_id] END) AS node_id
  FROM scen s JOIN thr t ON t.ts >= s.start_time AND t.ts <= s.end_time)
SELECT DISTINCT incident_id, node_id, nb AS neighbors FROM touched JOIN (SELECT node_id, array_to_string(list(DISTINCT neighbor ORDER BY neighbor), ',') AS nb FROM inc GROUP BY 1) USING (node_id)"""))(
    lambda spark, d: X.affected_neighbors(incidents(spark, d), T.links(spark, d)).select("incident_id", "node_id", F.array_join("neighbors", ",").alias("neighbors"))
)


@query("incident_documents")
def incident_documents(spark, d):
    rows = incidents(spark, d)
    return X.incident_documents(rows, C.root_causes(rows, graph(spark, d)), T.state(spark, d), T.links(spark, d))


query("status_summary", sql("ens act", f"""
SELECT count(*) AS anomalies, max_by(severity, {RANK.format('severity')}) AS worst_severity, epoch_us(max(ts)) AS last_us, (SELECT count(*) FROM act) AS actions,
       (SELECT count(*) FROM act WHERE action_type IN ('reroute', 'config_rollback')) AS pending FROM ens"""))(
    lambda spark, d: io.status(
        ensemble_rows(spark, d), T.action_log(spark, d), T.action_log(spark, d).where("action_type IN ('reroute', 'config_rollback')")
    ).withColumn("last_us", F.unix_micros("last_anomaly_ts")).drop("last_anomaly_ts")
)

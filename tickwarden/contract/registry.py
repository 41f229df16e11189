from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Views shared by the oracle texts, in dependency order.
VIEWS: dict[str, str] = {
    "tel": """
SELECT e.ts, e.event_id AS seq, e.value,
       CASE WHEN e.event_type = 'signup' THEN 'U' || e.user_id ELSE 'N' || c.c_nationkey || '-U' || e.user_id END AS entity_id,
       CASE WHEN e.event_type = 'signup' THEN 'node' ELSE 'link' END AS entity_type,
       CASE e.event_type WHEN 'click' THEN 'utilization_pct' WHEN 'view' THEN 'latency_ms' WHEN 'error' THEN 'packet_loss_pct'
            WHEN 'purchase' THEN 'throughput_gbps' ELSE 'cpu_pct' END AS metric
FROM events e JOIN customer c ON c.c_custkey = e.user_id""",
    "utel": """
SELECT ts, event_id AS seq, value, 'U' || user_id AS entity_id,
       CASE WHEN event_type = 'signup' THEN 'node' ELSE 'link' END AS entity_type,
       CASE event_type WHEN 'click' THEN 'utilization_pct' WHEN 'view' THEN 'latency_ms' WHEN 'error' THEN 'packet_loss_pct'
            WHEN 'purchase' THEN 'throughput_gbps' ELSE 'cpu_pct' END AS metric
FROM events""",
    "homes": "SELECT DISTINCT e.user_id, c.c_nationkey FROM events e JOIN customer c ON c.c_custkey = e.user_id",
    "nodes": """
SELECT 'R' || r_regionkey AS node_id, 'core' AS node_type, r_name AS region, 400.0::DOUBLE AS capacity_gbps, 0::BIGINT AS customers FROM region
UNION ALL SELECT 'N' || n_nationkey, 'aggregation', r_name, 100.0::DOUBLE, 0::BIGINT FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'U' || h.user_id, 'edge', r_name, 40.0::DOUBLE, coalesce(o.n, 0)::BIGINT
FROM homes h JOIN nation ON n_nationkey = h.c_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = h.user_id""",
    "links": """
SELECT least(s, t) || '-' || greatest(s, t) AS link_id, s AS source, t AS target, cap AS capacity_gbps, lat AS latency_baseline_ms FROM (
  SELECT 'R' || a.r_regionkey AS s, 'R' || b.r_regionkey AS t, 200.0::DOUBLE AS cap, 5.0::DOUBLE AS lat
  FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey
  UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, 100.0::DOUBLE, 2.0::DOUBLE FROM nation
  UNION ALL SELECT 'N' || a.n_nationkey, 'N' || min(b.n_nationkey), 40.0::DOUBLE, 1.0::DOUBLE
  FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey GROUP BY a.n_nationkey
  UNION ALL SELECT 'N' || c_nationkey, 'U' || user_id, 40.0::DOUBLE, (20.0 + 2.0 * c_nationkey)::DOUBLE FROM homes)""",
    "inc": """
SELECT link_id, source AS node_id, target AS neighbor FROM links
UNION ALL SELECT link_id, target, source FROM links""",
    "state": """
SELECT entity_id, entity_type, metric, max_by(value, {'ts': ts, 'seq': seq}) AS value FROM tel GROUP BY ALL""",
    "util": "SELECT entity_id AS link_id, value FROM state WHERE metric = 'utilization_pct'",
    "scen": """
SELECT 'SC' || e.event_id AS scenario_id, e.event_id, e.value, e.ts AS start_time, e.ts + INTERVAL 45 MINUTE AS end_time,
       CASE e.user_id % 5 WHEN 0 THEN 'congestion_cascade' WHEN 1 THEN 'hardware_degradation' WHEN 2 THEN 'ddos_surge'
            WHEN 3 THEN 'misconfiguration' ELSE 'fiber_cut' END AS scenario_type,
       CASE WHEN e.value > 300 THEN 'critical' WHEN e.value > 250 THEN 'high' ELSE 'medium' END AS severity,
       CASE WHEN e.value > 300 THEN 3 WHEN e.value > 250 THEN 2 ELSE 1 END AS rank,
       e.user_id % 5 IN (1, 2) AS on_node, 'U' || e.user_id AS u, 'N' || c.c_nationkey AS n,
       'N' || c.c_nationkey || '-U' || e.user_id AS l
FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'error' AND e.value > 200""",
    "hyp": """
SELECT scenario_id AS hypothesis_id, on_node, u, n, l, severity, value,
       'A ' || severity || ' ' || replace(scenario_type, '_', ' ') || ' is likely at ' || CASE WHEN on_node THEN u ELSE l END AS description,
       CASE WHEN on_node THEN u || '_cpu' ELSE l || '_utilization' END AS root_cause,
       round(least(0.99, value / 400), 4) AS confidence,
       printf('packet_loss_pct=%.2f on ', value) || l AS evidence
FROM scen""",
    "ends": """
SELECT scenario_id, unnest(CASE WHEN on_node THEN [u, split_part(l, '-', 1)] ELSE [n, u] END) AS node_id FROM scen""",
    "lines": "SELECT l_orderkey, sum(l_quantity) AS qty, max(l_discount) AS disc FROM lineitem GROUP BY 1",
    "act": """
SELECT 'A' || o_orderkey AS action_id, o_orderkey, o_custkey, ts, action_type, scenario_type, pre_price / 1000 AS pre_latency,
       price / 1000 AS post_latency, pre_qty AS pre_util, qty AS post_util, pre_disc * 100 AS pre_loss, disc * 100 AS post_loss
FROM (
  SELECT o_orderkey, o_custkey, o_orderdate AS ts, o_totalprice AS price, coalesce(qty, 0) AS qty, coalesce(disc, 0) AS disc,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'reroute' WHEN '2-HIGH' THEN 'rate_limit' WHEN '3-MEDIUM' THEN 'config_rollback'
              WHEN '4-NOT SPECIFIED' THEN 'escalate' ELSE 'create_ticket' END AS action_type,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'congestion_cascade' WHEN 'BUILDING' THEN 'hardware_degradation'
              WHEN 'FURNITURE' THEN 'ddos_surge' WHEN 'HOUSEHOLD' THEN 'misconfiguration' ELSE 'fiber_cut' END AS scenario_type,
         lag(o_totalprice) OVER w AS pre_price, lag(coalesce(qty, 0)) OVER w AS pre_qty, lag(coalesce(disc, 0)) OVER w AS pre_disc
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lines ON l_orderkey = o_orderkey
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE pre_price IS NOT NULL""",
    "outc": """
SELECT action_id, ts, action_type, scenario_type, improved, harmful,
       CASE WHEN harmful THEN 'harmful' WHEN improved > 3 - improved AND improved > 0 THEN 'effective'
            WHEN improved > 0 AND 3 - improved > 0 THEN 'partially_effective' ELSE 'ineffective' END AS outcome
FROM (
  SELECT action_id, ts, action_type, scenario_type,
         CASE WHEN pre_latency > 0 AND (pre_latency - post_latency) / pre_latency > 0.10 THEN 1 ELSE 0 END
       + CASE WHEN pre_util > 0 AND (pre_util - post_util) / pre_util > 0.05 THEN 1 ELSE 0 END
       + CASE WHEN pre_loss > 0 AND (pre_loss - post_loss) / pre_loss > 0.50 THEN 1 ELSE 0 END AS improved,
         (pre_latency > 0 AND post_latency > pre_latency * 1.2::DOUBLE) OR (pre_util > 0 AND post_util > pre_util * 1.2::DOUBLE)
         OR (pre_loss > 0 AND post_loss > pre_loss * 1.2::DOUBLE) AS harmful
  FROM act)""",
    "lim": """
SELECT t.*, CASE t.metric WHEN 'utilization_pct' THEN 85.0::DOUBLE WHEN 'packet_loss_pct' THEN 1.0::DOUBLE WHEN 'cpu_pct' THEN 90.0::DOUBLE
            WHEN 'latency_ms' THEN coalesce(l.latency_baseline_ms, 5.0::DOUBLE) * 2.5::DOUBLE END AS "limit"
FROM tel t LEFT JOIN links l ON l.link_id = t.entity_id""",
    "thr": """
SELECT ts, entity_id, metric, round(value, 6) AS observed, round("limit", 6) AS expected,
       CASE WHEN value / "limit" >= 1.3 THEN 'critical' WHEN value / "limit" >= 1.1 THEN 'high' ELSE 'medium' END AS severity,
       0.7::DOUBLE AS confidence, 'threshold' AS detector, seq
FROM lim WHERE value > "limit" """,
    "ew": """
SELECT *, len(h) AS n_before,
       CASE WHEN len(h) > 0 THEN list_reduce(h, lambda a, x: {'m': a.m + (x.m - a.m) * (2.0::DOUBLE / 21),
           'v': (1 - 2.0::DOUBLE / 21) * (a.v + (2.0::DOUBLE / 21) * (x.m - a.m) * (x.m - a.m))}) END AS s
FROM (SELECT *, list({'m': value, 'v': 0.0::DOUBLE}) OVER (PARTITION BY entity_id, metric ORDER BY ts, seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM tel)""",
    "ewh": """
SELECT ts, entity_id, metric, round(value, 6) AS observed, round(s.m, 6) AS expected,
       CASE WHEN z >= 5 THEN 'critical' WHEN z >= 4 THEN 'high' ELSE 'medium' END AS severity,
       least(0.99, round(least(0.95, z / 3.0 * 0.7), 4))::DOUBLE AS confidence, 'ewma' AS detector, seq
FROM (SELECT *, abs(value - s.m) / sqrt(s.v) AS z FROM ew WHERE n_before >= 10 AND sqrt(s.v) >= 1e-6) WHERE z >= 3""",
    "ens": """
SELECT ts, entity_id, metric, seq, b.observed AS observed, b.expected AS expected, b.severity AS severity, b.detector AS detector, votes,
       CASE WHEN votes >= 2 THEN round(least(0.99, b.confidence + 0.15), 4)::DOUBLE ELSE b.confidence END AS confidence
FROM (SELECT ts, entity_id, metric, seq, count(*) AS votes,
             max_by({'observed': observed, 'expected': expected, 'severity': severity, 'confidence': confidence, 'detector': detector},
                    {'c': confidence, 'd': CASE detector WHEN 'threshold' THEN 0 ELSE -1 END}) AS b
      FROM (SELECT * FROM thr UNION ALL SELECT * FROM ewh) GROUP BY ts, entity_id, metric, seq)""",
}

# The same moving averages over the telemetry without the home nation in its names, as the streams have it.
VIEWS["uew"] = VIEWS["ew"].replace("FROM tel)", "FROM utel)")
VIEWS["uewh"] = VIEWS["ewh"].replace("FROM ew ", "FROM uew ")

# The events as they reach a stream: in batches of five days, some one or two batches later, some twice. A batch's
# watermark is the latest time of earlier batches less two days; what it has passed is late.
VIEWS["arr"] = """
SELECT u.*, (epoch_us(ts) // 86400000000 - (SELECT min(epoch_us(ts) // 86400000000) FROM utel)) // 5
            + CASE WHEN seq % 23 = 0 THEN 2 WHEN seq % 29 = 0 THEN 1 ELSE 0 END AS batch
FROM utel u, LATERAL (SELECT unnest(CASE WHEN u.seq % 19 = 0 THEN [1, 2] ELSE [1] END)) AS copies(copy)"""
VIEWS["marks"] = """
SELECT batch, coalesce(max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 172800000, 0) AS mark
FROM (SELECT batch, max(epoch_us(ts) // 1000) AS latest FROM arr GROUP BY batch)"""
VIEWS["acc"] = """
SELECT DISTINCT ts, seq, value, entity_id, entity_type, metric FROM arr JOIN marks USING (batch) WHERE epoch_us(ts) > mark * 1000"""
VIEWS["aew"] = VIEWS["ew"].replace("FROM tel)", "FROM acc)")
VIEWS["aewh"] = VIEWS["ewh"].replace("FROM ew ", "FROM aew ")
VIEWS["alim"] = """
SELECT *, CASE metric WHEN 'utilization_pct' THEN 85.0::DOUBLE WHEN 'packet_loss_pct' THEN 1.0::DOUBLE WHEN 'cpu_pct' THEN 90.0::DOUBLE
          WHEN 'latency_ms' THEN 12.5::DOUBLE END AS "limit" FROM acc"""
VIEWS["athr"] = VIEWS["thr"].replace("FROM lim ", "FROM alim ")
VIEWS["aens"] = VIEWS["ens"].replace("FROM thr UNION ALL SELECT * FROM ewh", "FROM athr UNION ALL SELECT * FROM aewh")

RANK = "CASE {0} WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


def sql(views: str, body: str, recursive: bool = False) -> str:
    """Oracle text: the named shared views and everything they use, then the query."""
    import re

    needed: set[str] = set()
    queue = views.split()
    while queue:
        name = queue.pop()
        if name in needed:
            continue
        needed.add(name)
        queue += [other for other in VIEWS if other != name and re.search(rf"\b{other}\b", VIEWS[name]) and re.search(rf"(FROM|JOIN)\s+{other}\b", VIEWS[name])]
    parts = [f"{name} AS ({text.strip()})" for name, text in VIEWS.items() if name in needed]
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if body.startswith("WITH "):
        return head + ",\n".join(parts + [body[5:]])
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register

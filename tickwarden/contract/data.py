"""Quality, reshape, text, retrieval, dataset and stream queries."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tickwarden.contract.detection import day, ensemble_rows, micros, shown, threshold_rows
from tickwarden.contract.network import incidents
from tickwarden.contract.registry import RANK, query, sql
from tickwarden.functions import ids as I
from tickwarden.functions import text as TX
from tickwarden.functions.severity import clamp, node_status
from tickwarden.operators import datasets as DS
from tickwarden.operators import detect as D
from tickwarden.operators import quality as Q
from tickwarden.operators import reshape as R
from tickwarden.operators import retrieval as RG
from tickwarden.operators.evaluation import dataset_summary
from tickwarden.operators.intervals import label_times
from tickwarden.plans import evaluation as PE
from tickwarden.schemas import METRICS
from tickwarden.session import cut, shared_dir
from tickwarden.sources import io
from tickwarden.sources import tables as T
from tickwarden.streaming import processors as SP
from tickwarden.streaming import observe as SO
from tickwarden.streaming.cycle import drain

# -- quality -----------------------------------------------------------------------------------------------------


def broken(rows):
    return rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


query("validate_readings", sql("tel", """
SELECT * FROM (SELECT 'pct_range' AS reason, count(*) AS n FROM tel WHERE metric IN ('utilization_pct', 'packet_loss_pct') AND NOT value BETWEEN 0 AND 100
UNION ALL SELECT 'negative_metric', count(*) FROM tel WHERE value < 0 UNION ALL SELECT 'link_id_format', count(*) FROM tel WHERE entity_type = 'link' AND NOT contains(entity_id, '-')) WHERE n > 0"""))(
    lambda spark, d: broken(Q.validate(T.telemetry(spark, d), Q.long_reading_rules(F.col("entity_id"), F.col("entity_type"), F.col("metric"), F.col("value"))))
)


def metric_maps(spark, d):
    return T.state(spark, d).groupBy("entity_id", "entity_type").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))


query("validate_metric_maps", sql("state", """
SELECT entity_id, coalesce(max(value) FILTER (metric = 'utilization_pct'), 0) > 100 AS util_bad, coalesce(max(value) FILTER (metric = 'packet_loss_pct'), 0) > 100 AS loss_bad
FROM state GROUP BY 1 HAVING util_bad OR loss_bad"""))(
    lambda spark, d: Q.rejects(Q.validate(metric_maps(spark, d), Q.reading_rules(F.when(F.col("entity_type") == "link", F.col("entity_id")), F.col("metrics")))).select(
        "entity_id", F.array_contains("reasons", "utilization_range").alias("util_bad"), F.array_contains("reasons", "loss_range").alias("loss_bad"))
)


def link_states(spark, d):
    pick = lambda m: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)).alias(m)
    wide = T.state(spark, d).where("entity_type = 'link'").groupBy(F.col("entity_id").alias("link_id")).agg(
        *[pick(m) for m in ("latency_ms", "packet_loss_pct", "utilization_pct", "throughput_gbps")])
    return wide.join(T.links(spark, d), "link_id").withColumn("status", F.when(F.col("utilization_pct") > 90, "busy").otherwise("healthy"))


query("validate_link_states", sql("state links", """
WITH w AS (SELECT entity_id, coalesce(max(value) FILTER (metric = 'packet_loss_pct'), 0) AS p, coalesce(max(value) FILTER (metric = 'utilization_pct'), 0) AS u,
  coalesce(max(value) FILTER (metric = 'throughput_gbps'), 0) AS t, any_value(capacity_gbps) AS c FROM state JOIN links ON link_id = entity_id GROUP BY 1)
SELECT * FROM (SELECT 'packet_loss_pct' AS reason, count(*) FILTER (p > 100) AS n FROM w UNION ALL SELECT 'utilization_pct', count(*) FILTER (u > 100) FROM w
UNION ALL SELECT 'over_capacity', count(*) FILTER (t > c) FROM w UNION ALL SELECT 'status', count(*) FILTER (u > 90) FROM w) WHERE n > 0"""))(
    lambda spark, d: broken(Q.validate(link_states(spark, d), Q.link_rules()))
)


def node_states(spark, d):
    cpu = T.state(spark, d).where("metric = 'cpu_pct'").select(F.col("entity_id").alias("node_id"), F.col("value").alias("cpu_pct"))
    rows = T.nodes(spark, d).join(cpu, "node_id", "left").withColumns({
        "memory_pct": F.lit(50.0), "temperature_c": F.col("cpu_pct") - 12, "buffer_drops": F.lit(0)})
    return rows.withColumn("status", node_status(F.col("cpu_pct"), F.lit(0.0), F.lit(0.0)))


query("validate_node_states", sql("state nodes", """
WITH w AS (SELECT value FROM nodes LEFT JOIN state ON entity_id = node_id AND metric = 'cpu_pct')
SELECT * FROM (SELECT 'cpu_pct' AS reason, count(*) FILTER (NOT value BETWEEN 0 AND 100) AS n FROM w
UNION ALL SELECT 'temperature_c', count(*) FILTER (NOT value - 12 BETWEEN -10 AND 200) FROM w) WHERE n > 0"""))(
    lambda spark, d: broken(Q.validate(node_states(spark, d), Q.node_rules()))
)
query("validate_anomalies", sql("ens", """
SELECT entity_id, metric, epoch_us(ts) AS ts_us FROM ens WHERE confidence > 0.9 OR observed > 300"""))(
    lambda spark, d: Q.rejects(Q.validate(
        ensemble_rows(spark, d).withColumns({
            "node_id": F.when((F.col("observed") <= 300) & ~I.is_link(F.col("entity_id")), F.col("entity_id")),
            "link_id": F.when((F.col("observed") <= 300) & I.is_link(F.col("entity_id")), F.col("entity_id")),
            "confidence": F.col("confidence") + 0.1}),
        {**Q.anomaly_rules(), "confidence": F.round("confidence", 6) <= 1.0})).select("entity_id", "metric", micros())
)


def event_rows(events):
    """Events as readings of the user they belong to."""
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("U"), F.col("user_id")).alias("entity_id"),
        F.when(F.col("event_type") == "signup", "node").otherwise("link").alias("entity_type"),
        I.lookup(T.EVENT_METRIC, F.col("event_type")).alias("metric"), "value", F.col("event_id").alias("seq"),
    )


query("validate_anomaly_records", sql("ens", """
SELECT * FROM (SELECT 'confidence' AS reason, count(*) FILTER (observed / 300.0::DOUBLE > 1) AS n FROM ens
UNION ALL SELECT 'target', count(*) FILTER (expected > 100) FROM ens) WHERE n > 0"""))(
    lambda spark, d: broken(Q.validate(
        ensemble_rows(spark, d).withColumns({
            "node_id": F.when((F.col("expected") <= 100) & ~I.is_link(F.col("entity_id")), F.col("entity_id")),
            "link_id": F.when((F.col("expected") <= 100) & I.is_link(F.col("entity_id")), F.col("entity_id")),
            "confidence": F.col("observed") / 300.0}), Q.anomaly_rules()))
)


@query("sanitised_snapshots", sql("utel", """
SELECT epoch_us(ts) AS ts_us, entity_id, entity_type, metric, value FROM utel WHERE value BETWEEN 5 AND 400"""))
def sanitised_snapshots(spark, d):
    """Snapshots with an unknown metric; times above 400 cannot be read, values below 5 are no numbers."""
    rows = event_rows(T.table(spark, d, "events"))
    text = F.when(F.col("value") > 400, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    metrics = F.create_map("metric", F.when(F.col("value") < 5, float("nan")).otherwise(F.col("value")), F.lit("colour"), F.lit(1.0))
    side = lambda kind: F.when(F.col("entity_type") == kind, F.create_map("entity_id", metrics)).alias(kind + "s")
    return Q.sanitize(rows.select(text.alias("timestamp"), side("node"), side("link"))).select(micros(), "entity_id", "entity_type", "metric", "value")


@query("baseline_from_csv", sql("utel", "SELECT epoch_us(ts) AS ts_us, entity_id, entity_type, metric, value FROM utel"))
def baseline_from_csv(spark, d):
    """Flat telemetry written as CSV, read back, accepted as a baseline and taken apart into readings."""
    rows = event_rows(T.table(spark, d, "events"))
    wide = rows.select(F.col("ts").alias("timestamp"), "entity_id", "entity_type", *[F.when(F.col("metric") == m, F.col("value")).alias(m) for m in METRICS])
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    io.write_telemetry(wide, path)
    return R.to_long(Q.check_baseline(io.read_telemetry(spark, path, "csv"))).select(micros(), "entity_id", "entity_type", "metric", "value")


@query("audit_log", sql("thr", """
SELECT epoch_us(ts) AS ts_us, entity_id, metric, severity FROM thr WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'"""))
def audit_log(spark, d):
    """Anomalies appended to a log in two runs; sixteen days are read."""
    path = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    rows = cut(threshold_rows(spark, d))
    for part in ("severity = 'critical'", "severity <> 'critical'"):
        io.append_log(rows.where(part), path)
    return io.read_log(spark, path, "2024-01-05", "2024-01-20").select(micros(), "entity_id", "metric", "severity")


def order_actions(spark, d):
    return T.table(spark, d, "orders").select(
        F.concat(F.lit("A"), "o_orderkey").alias("action_id"), I.lookup(T.PRIORITY_ACTION, F.col("o_orderpriority")).alias("action_type"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("U"), "o_custkey")).alias("target_node"), F.lit(None).cast("string").alias("target_link"),
        (F.col("o_totalprice") / 400000).alias("risk_level"), (F.col("o_orderstatus") == "F").alias("rollback_available"),
        F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("T"), "o_orderkey")).alias("rollback_token"),
        F.when(F.col("o_totalprice") > 450000, "unknown").otherwise("effective").alias("outcome"))


query("validate_actions", sql("", """
SELECT * FROM (SELECT 'target' AS reason, count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW')) AS n FROM orders
UNION ALL SELECT 'risk_level', count(*) FILTER (o_totalprice / 400000 > 1) FROM orders) WHERE n > 0"""))(
    lambda spark, d: broken(Q.validate(order_actions(spark, d), Q.action_rules()))
)
query("validate_results", sql("", """
SELECT * FROM (SELECT 'rollback_token' AS reason, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice <= 100000) AS n FROM orders
UNION ALL SELECT 'outcome', count(*) FILTER (o_totalprice > 450000) FROM orders) WHERE n > 0"""))(
    lambda spark, d: broken(Q.validate(order_actions(spark, d), Q.result_rules()))
)
query("normalise_times", sql("", """
SELECT event_id, CASE WHEN event_type = 'error' THEN -1 WHEN event_type = 'view' THEN epoch_us(ts) - 7200000000 ELSE epoch_us(ts) END AS ts_us FROM events"""))(
    lambda spark, d: T.table(spark, d, "events").select(
        "event_id", F.coalesce(F.unix_micros(Q.parse_time(
            F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
            .when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'"))
            .when(F.col("event_type") == "error", F.concat(F.lit("at "), F.date_format("ts", "HH:mm")))
            .otherwise(F.date_format("ts", "' 'yyyy-MM-dd HH:mm:ss.SSSSSS")))), F.lit(-1)).alias("ts_us"))
)
query("coerce_numeric", sql("", """
SELECT o_orderstatus, count(*) AS n, count(try_cast(substr(o_orderpriority, 1, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END) AS DOUBLE)) AS parsed,
       round(sum(try_cast(substr(o_orderpriority, 1, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END) AS DOUBLE)), 4) AS total FROM orders GROUP BY 1"""))(
    lambda spark, d: T.table(spark, d, "orders").select(
        "o_orderstatus", Q.to_number(F.substring(F.col("o_orderpriority"), F.lit(1), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2))).alias("x")
    ).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("x").alias("parsed"), F.round(F.sum("x"), 4).alias("total"))
)
query("parse_props", sql("", """
SELECT event_type, count(*) AS n, sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1"""))(
    lambda spark, d: T.table(spark, d, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k")).groupBy("event_type").agg(
        F.count("k").alias("n"), F.sum("k").alias("total"))
)


def responses(spark, d):
    """Stored model responses of five shapes, written from the events."""
    item = F.concat(
        F.lit('{"root_cause": "U'), "user_id", F.lit('_cpu", "confidence": '), F.format_string("%.4f", F.col("value") / 100),
        F.lit(', "evidence": ["k='), F.get_json_object("props", "$.k"), F.lit('", "seen"], "affected_nodes": "U'), "user_id", F.lit('"}'))
    short = F.concat(F.lit('{"root_cause": "U'), "user_id", F.lit('_cpu", "confidence": '), F.format_string("%.4f", F.col("value") / 100), F.lit("}"))
    kind = F.col("event_type")
    return T.table(spark, d, "events").select(
        "event_id",
        F.when(kind == "click", F.concat(F.lit('```json\n{"hypotheses": ['), item, F.lit("]}\n```")))
        .when(kind == "view", F.concat(F.lit("["), item, F.lit(", 3]")))
        .when(kind == "error", F.concat(F.lit("Most likely: "), short, F.lit(" as the data shows.")))
        .when(kind == "signup", F.concat(F.lit("Here it is: ["), item, F.lit(", "), item, F.lit("] done")))
        .otherwise(F.lit("No idea.")).alias("text"))


query("parse_hypotheses", sql("", """
SELECT event_id, root_cause, round(conf, 4) AS confidence, CASE WHEN event_type = 'error' THEN 0 ELSE 2 END AS n_evidence,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS n_nodes, root_cause IS NULL AS fallback FROM (
  SELECT event_id, event_type, 'U' || user_id || '_cpu' AS root_cause, least(1.0, CAST(printf('%.4f', value / 100) AS DOUBLE)) AS conf, unnest(range(CASE event_type WHEN 'signup' THEN 2 ELSE 1 END)) AS i
  FROM events WHERE event_type <> 'purchase')"""))(
    lambda spark, d: responses(spark, d).select("event_id", F.explode(TX.hypothesis_items(F.col("text"))).alias("h")).select(
        "event_id", F.col("h.root_cause").alias("root_cause"), F.round("h.confidence", 4).alias("confidence"),
        F.size("h.evidence").alias("n_evidence"), F.size("h.affected_nodes").alias("n_nodes"), F.col("h.root_cause").isNull().alias("fallback"))
)
query("normalise_opinions", sql("", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'support' WHEN 'view' THEN 'oppose' ELSE 'conditional' END AS position,
       CASE event_type WHEN 'error' THEN 'approve' WHEN 'signup' THEN 'reject' ELSE 'modify' END AS verdict, round(least(greatest(value / 100, 0), 1), 6)::DOUBLE AS confidence,
       CASE WHEN event_type = 'purchase' THEN 'No argument provided.' ELSE event_type || ' seen' END AS argument FROM events"""))(
    lambda spark, d: T.table(spark, d, "events").select(
        "event_id",
        TX.normal_position(F.when(F.col("event_type") == "click", "SUPPORT").when(F.col("event_type") == "view", "oppose").otherwise("maybe")).alias("position"),
        TX.normal_verdict(F.when(F.col("event_type") == "error", "Approve").when(F.col("event_type") == "signup", "REJECT").otherwise("later")).alias("verdict"),
        F.round(clamp(F.col("value") / 100, 0, 1), 6).alias("confidence"),
        TX.joined_argument(F.when(F.col("event_type") != "purchase", F.array(F.col("event_type"), F.lit("seen")))).alias("argument"))
)

# -- scalar functions --------------------------------------------------------------------------------------------

query("causal_variables", sql("tel", """
SELECT DISTINCT entity_id, metric, entity_id || '_' || s AS variable, s AS short, entity_id AS entity_back, metric AS metric_back,
       CASE WHEN s = 'packet_loss' THEN entity_id || '_packet' ELSE entity_id END AS strict_entity,
       CASE WHEN contains(entity_id, '-') THEN split_part(entity_id, '-', 1) END AS a, CASE WHEN contains(entity_id, '-') THEN split_part(entity_id, '-', 2) END AS b,
       CASE WHEN contains(entity_id, '-') THEN entity_id END AS canonical, true AS named
FROM (SELECT *, CASE metric WHEN 'utilization_pct' THEN 'utilization' WHEN 'latency_ms' THEN 'latency' WHEN 'packet_loss_pct' THEN 'packet_loss' WHEN 'throughput_gbps' THEN 'throughput' ELSE 'cpu' END AS s FROM tel)"""))(
    lambda spark, d: variables(spark, d)
)


def variables(spark, d):
    rows = T.telemetry(spark, d).select("entity_id", "metric").distinct().withColumn("variable", I.variable(F.col("entity_id"), F.col("metric")))
    entity, short = I.split_variable(F.col("variable"))
    strict, _ = I.split_variable(F.col("variable"), True)
    a, b = I.endpoint(F.col("entity_id"), 0), I.endpoint(F.col("entity_id"), 1)
    return rows.select(
        "entity_id", "metric", "variable", I.short_metric(F.col("metric")).alias("short"), entity.alias("entity_back"), I.full_metric(short).alias("metric_back"),
        strict.alias("strict_entity"), a.alias("a"), b.alias("b"), F.when(a.isNotNull(), I.link_id(b, a)).alias("canonical"),
        I.mentions(F.col("variable"), F.lower("entity_id")).alias("named"))


query("text_classes", sql("", """
SELECT outcome, decision, severity, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (
  SELECT n_chars, CASE WHEN regexp_matches(t, 'ddos|surge') THEN 'ddos_surge' WHEN regexp_matches(t, 'misconfig|rollback') THEN 'misconfiguration'
    WHEN regexp_matches(t, 'down|fiber') THEN 'fiber_cut' WHEN regexp_matches(t, 'hardware|temperature|cpu') THEN 'hardware_degradation' ELSE 'congestion_cascade' END AS outcome,
  CASE WHEN regexp_matches(t, 'ddos|surge|flood|attack') THEN 'ddos' WHEN regexp_matches(t, 'misconfig|configuration|rollback|route leak') THEN 'misconfiguration'
    WHEN regexp_matches(t, 'link down|fiber cut|down|disconnected') THEN 'link_down' WHEN regexp_matches(t, 'hardware|temperature|cpu|memory|buffer') THEN 'hardware' ELSE 'congestion' END AS decision,
  CASE WHEN contains(t, 'critical') THEN 'critical' WHEN contains(t, 'high') THEN 'high' WHEN contains(t, 'low') THEN 'low' ELSE 'medium' END AS severity
  FROM (SELECT lower(text) AS t, n_chars FROM documents)) GROUP BY ALL"""))(
    lambda spark, d: T.table(spark, d, "documents").withColumn("t", F.lower("text")).select(
        TX.outcome_class(F.col("t")).alias("outcome"), TX.decision_class(F.col("t")).alias("decision"), TX.text_severity(F.col("t")).alias("severity"), "n_chars"
    ).groupBy("outcome", "decision", "severity").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
)
query("learning_titles", sql("", "SELECT doc_id, 'Incident Learning: ' || substr(text, 1, 60) || '...' AS title FROM documents"))(
    lambda spark, d: T.table(spark, d, "documents").select("doc_id", TX.learning_title(F.col("text")).alias("title"))
)

# -- reshape -----------------------------------------------------------------------------------------------------


def wide(spark, d):
    return T.user_telemetry(spark, d).groupBy(F.col("ts").alias("timestamp"), "entity_id", "entity_type").pivot("metric", list(METRICS)).agg(F.min_by("value", "seq"))


query("wide_to_long", sql("utel", "SELECT entity_id, entity_type, metric, count(*) AS n, round(sum(value), 4) AS total FROM utel GROUP BY ALL"))(
    lambda spark, d: R.to_long(wide(spark, d)).groupBy("entity_id", "entity_type", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
)
query("snapshot_nested", sql("tel", """
WITH r AS (SELECT epoch_us(ts) // 86400000000 AS day, entity_id, entity_type, metric, min_by(value, seq) AS value FROM tel GROUP BY ALL)
SELECT day, count(DISTINCT entity_id) FILTER (entity_type = 'node')::INT AS nodes, count(DISTINCT entity_id) FILTER (entity_type = 'link')::INT AS links, round(sum(value), 4) AS total FROM r GROUP BY 1"""))(
    lambda spark, d: R.to_snapshots(T.telemetry(spark, d).withColumn("ts", day())).select(
        F.col("ts").alias("day"), F.size("nodes").alias("nodes"), F.size("links").alias("links"),
        F.round(F.aggregate(F.flatten(F.transform(F.concat(F.map_values("nodes"), F.map_values("links")), lambda m: F.map_values(m))), F.lit(0.0), lambda a, v: a + v), 4).alias("total"))
)
query("snapshot_flatten", sql("tel", "SELECT epoch_us(ts) // 86400000000 AS day, entity_id, entity_type, metric, min_by(value, seq) AS value FROM tel GROUP BY ALL"))(
    lambda spark, d: R.flatten_snapshots(R.to_snapshots(T.telemetry(spark, d).withColumn("ts", day())), "ts").withColumnRenamed("ts", "day")
)
query("distinct_readings", sql("tel", """
SELECT day, entity_id, metric, seq, value FROM (SELECT *, epoch_us(ts) // 86400000000 AS day, row_number() OVER (PARTITION BY epoch_us(ts) // 86400000000, entity_id, metric ORDER BY seq) AS rn FROM tel) WHERE rn = 1"""))(
    lambda spark, d: R.distinct_readings(T.telemetry(spark, d).withColumn("ts", day())).select(F.col("ts").alias("day"), "entity_id", "metric", "seq", "value")
)
query("pivot_matrix", sql("tel", """
SELECT epoch_us(ts) // 3600000000 AS t, min_by(value, seq) FILTER (metric = 'utilization_pct') AS net_utilization, min_by(value, seq) FILTER (metric = 'latency_ms') AS net_latency,
       min_by(value, seq) FILTER (metric = 'packet_loss_pct') AS net_packet_loss, min_by(value, seq) FILTER (metric = 'throughput_gbps') AS net_throughput,
       min_by(value, seq) FILTER (metric = 'cpu_pct') AS net_cpu FROM tel GROUP BY 1"""))(
    lambda spark, d: R.metric_matrix(
        T.telemetry(spark, d).withColumns({"entity_id": F.lit("net"), "t": F.floor(F.unix_seconds("ts") / 3600)}),
        ["net_utilization", "net_latency", "net_packet_loss", "net_throughput", "net_cpu"], "t")
)
DAILY = "d AS (SELECT entity_id, metric, epoch_us(ts) // 86400000000 AS t, avg(value) AS value FROM tel GROUP BY ALL)"


@query("gap_fill", sql("tel", f"""WITH {DAILY}, grid AS (SELECT entity_id, metric, t FROM (SELECT DISTINCT entity_id, metric FROM d), range((SELECT min(t) FROM d), (SELECT max(t) + 1 FROM d)) r(t))
SELECT entity_id, metric, t, d.value IS NULL AS filled, round(coalesce(last_value(d.value IGNORE NULLS) OVER w, first_value(d.value IGNORE NULLS) OVER (PARTITION BY entity_id, metric ORDER BY t
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS value
FROM grid LEFT JOIN d USING (entity_id, metric, t) WINDOW w AS (PARTITION BY entity_id, metric ORDER BY t ROWS UNBOUNDED PRECEDING)"""))
def gap_fill(spark, d):
    daily = T.telemetry(spark, d).groupBy("entity_id", "metric", day().alias("t")).agg(F.avg("value").alias("value"))
    first, last = daily.agg(F.min("t"), F.max("t")).first()
    return R.gap_fill(daily, ["entity_id", "metric"], "t", "value", first, last).withColumn("value", F.round("value", 6))


@query("chart_series", sql("tel", """
WITH three AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) AS i FROM (SELECT DISTINCT entity_id FROM tel WHERE entity_type = 'link' ORDER BY 1 LIMIT 3))
SELECT epoch_us(ts) // 86400000000 AS day, min_by(value, seq) FILTER (i = 1) AS e1, min_by(value, seq) FILTER (i = 2) AS e2, min_by(value, seq) FILTER (i = 3) AS e3
FROM tel JOIN three USING (entity_id) WHERE metric = 'utilization_pct' GROUP BY 1"""))
def chart_series(spark, d):
    long = T.telemetry(spark, d).withColumn("day", day())
    names = [r[0] for r in R.first_entities(long, "link").collect()]
    rows = R.chart_series(long, "utilization_pct", names, "day")
    return rows.select("day", *[F.col(f"`{n}`").alias(f"e{i}") for i, n in enumerate(names, 1)])


query("history_60", sql("tel", """
SELECT metric, seq, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total, first_value(value) OVER w AS oldest FROM tel
WINDOW w AS (PARTITION BY metric ORDER BY ts, seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""))(
    lambda spark, d: R.history(T.telemetry(spark, d), ["metric"], ["ts", "seq"]).select(
        "metric", "seq", F.size("history").cast("long").alias("n"), F.round(F.aggregate("history", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.col("history")[0].alias("oldest"))
)
query("sliding_sequences", sql("tel", """
SELECT metric, seq, round(x, 4) AS x_total, round(y, 4) AS y_total FROM (
  SELECT metric, seq, sum(value) OVER a AS x, count(*) OVER a AS nx, sum(value) OVER b AS y, count(*) OVER b AS ny FROM tel
  WINDOW a AS (PARTITION BY metric ORDER BY ts, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), b AS (PARTITION BY metric ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
WHERE nx = 30 AND ny = 10"""))(
    lambda spark, d: R.training_windows(T.telemetry(spark, d), ["metric"], ["ts", "seq"]).select(
        "metric", "seq", *[F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 4).alias(c + "_total") for c in ("x", "y")])
)
query("minmax_scale", sql("tel", """
SELECT t.seq, round((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 8) AS scaled, round(value, 6) AS restored FROM tel t
JOIN (SELECT entity_id, metric, min(value) AS lo, max(value) AS hi FROM tel GROUP BY ALL) b USING (entity_id, metric)"""))(
    lambda spark, d: R.minmax_scale(T.telemetry(spark, d), ["entity_id", "metric"]).select(
        "seq", F.round("scaled", 8).alias("scaled"), F.round(R.minmax_restore(F.col("scaled"), F.col("lo"), F.col("span")), 6).alias("restored"))
)
query("capture_metrics", sql("scen state", """
SELECT scenario_id, array_to_string(list(entity_id || '.' || metric || '=' || printf('%.2f', value) ORDER BY entity_id || '.' || metric), ' ') AS metrics
FROM (SELECT DISTINCT scenario_id, unnest([n, u, l]) AS entity_id FROM scen) JOIN state USING (entity_id) GROUP BY 1"""))(
    lambda spark, d: captured(spark, d).select(
        "scenario_id", F.array_join(F.transform(F.map_entries("metrics"), lambda e: F.format_string("%s=%.2f", e["key"], e["value"])), " ").alias("metrics"))
)


def captured(spark, d):
    affected = T.scenarios(spark, d).select("scenario_id", F.explode(F.concat("affected_nodes", "affected_links")).alias("entity_id"))
    state = T.state(spark, d)
    return R.recapture_metrics(R.capture_metrics(state, affected, "scenario_id"), state, "scenario_id")


query("observation_vector", sql("state", """
SELECT nation, 4 * count(*)::INT AS width, round(sum(u) / 100 + sum(l) / 100 + sum(p) / 5 + sum(t) / 400, 6) AS total FROM (
  SELECT split_part(entity_id, '-', 1) AS nation, entity_id, coalesce(max(value) FILTER (metric = 'utilization_pct'), 0) AS u, coalesce(max(value) FILTER (metric = 'latency_ms'), 0) AS l,
         coalesce(max(value) FILTER (metric = 'packet_loss_pct'), 0) AS p, coalesce(max(value) FILTER (metric = 'throughput_gbps'), 0) AS t FROM state WHERE entity_type = 'link' GROUP BY ALL) GROUP BY 1"""))(
    lambda spark, d: R.observation_vector(
        T.state(spark, d).where("entity_type = 'link'").withColumn("nation", I.endpoint(F.col("entity_id"), 0)), "nation"
    ).select("nation", F.size("observation").alias("width"), F.round(F.aggregate("observation", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))
)
CUTOFF = dt.datetime(2024, 1, 21, tzinfo=dt.timezone.utc)
query("split_rows", sql("tel", """
SELECT CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'train' ELSE 'test' END AS split, metric, count(*) AS n, round(sum(value), 3) AS total FROM tel GROUP BY ALL"""))(
    lambda spark, d: R.split_at(T.telemetry(spark, d), "ts", CUTOFF).groupBy("split", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
)
query("dataset_summary", sql("tel scen", """
SELECT split, count(*) AS rows, count(DISTINCT ts) AS timestamps, count(DISTINCT CASE WHEN bad THEN ts END) AS anomalous_timestamps,
       round(100.0 * count(DISTINCT CASE WHEN bad THEN ts END) / count(DISTINCT ts), 4)::DOUBLE AS anomalous_pct FROM (
  SELECT t.ts, CASE WHEN t.ts < TIMESTAMP '2024-01-21' THEN 'train' ELSE 'test' END AS split, EXISTS (SELECT 1 FROM scen s WHERE t.ts >= s.start_time AND t.ts <= s.end_time) AS bad FROM tel t) GROUP BY 1"""))(
    lambda spark, d: dataset_summary(R.split_at(T.telemetry(spark, d), "ts", CUTOFF), label_times(T.telemetry(spark, d), T.scenarios(spark, d)))
)

# -- sets and logs -----------------------------------------------------------------------------------------------

query("affected_sets", sql("scen thr", """
WITH a AS (SELECT scenario_id, [n, u, l] AS own FROM scen), b AS (SELECT s.scenario_id, list(DISTINCT t.entity_id) AS seen FROM scen s JOIN thr t ON t.ts >= s.start_time AND t.ts <= s.end_time GROUP BY 1)
SELECT scenario_id, len(list_distinct(list_concat(own, seen)))::INT AS either, len(list_filter(seen, lambda x: NOT list_contains(own, x)))::INT AS unexpected FROM a JOIN b USING (scenario_id)"""))(
    lambda spark, d: incidents(spark, d).groupBy(F.col("incident_id").alias("scenario_id")).agg(F.collect_set("entity_id").alias("seen")).join(
        T.scenarios(spark, d).select("scenario_id", F.array_distinct(F.concat(F.split(F.element_at("affected_links", 1), "-"), "affected_links")).alias("own")), "scenario_id"
    ).select("scenario_id", F.size(F.array_union("own", "seen")).alias("either"), F.size(F.array_except("seen", "own")).alias("unexpected"))
)
query("distinct_sources", sql("", "SELECT DISTINCT source FROM documents"))(lambda spark, d: RG.sources(T.table(spark, d, "documents")))
query("latest_state", sql("tel", "SELECT entity_id, metric, max_by(value, {'t': ts, 's': seq}) AS value, epoch_us(max(ts)) AS ts_us FROM tel GROUP BY ALL"))(
    lambda spark, d: io.latest(T.telemetry(spark, d)).select("entity_id", "metric", "value", micros())
)
query("recent_anomalies", sql("ens", """
SELECT epoch_us(ts) AS ts_us, entity_id, metric, severity FROM ens ORDER BY ts DESC, seq DESC LIMIT 50"""))(
    lambda spark, d: io.recent(ensemble_rows(spark, d)).select(micros(), "entity_id", "metric", "severity")
)
query("event_envelopes", sql("thr", """
SELECT '{"type":"anomaly","payload":{"entity_id":"' || entity_id || '","metric":"' || metric || '","severity":"' || severity || '","at":' || epoch_us(ts) || '},"ts":' || epoch_us(ts) || '}' AS value FROM thr"""))(
    lambda spark, d: io.envelope(threshold_rows(spark, d).select("entity_id", "metric", "severity", F.unix_micros("ts").alias("at")), "anomaly", "at")
)

# -- documents ---------------------------------------------------------------------------------------------------

FIXED = """SELECT doc_id, source, i::INT AS chunk_no, substr(text, i::INT * 450 + 1, 500) AS text FROM (
  SELECT *, unnest(range(greatest(ceil((length(text) - 50) / 450.0)::INT, 1))) AS i FROM documents WHERE length(text) > 0)"""
query("chunk_fixed", sql("", f"SELECT doc_id, chunk_no, length(text)::INT AS chars, md5(text) AS digest FROM ({FIXED})"))(
    lambda spark, d: RG.chunk_fixed(T.table(spark, d, "documents")).select("doc_id", "chunk_no", F.length("text").alias("chars"), F.md5("text").alias("digest"))
)
query("chunk_counts", sql("", f"SELECT source, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM ({FIXED}) GROUP BY 1"))(
    lambda spark, d: RG.chunk_counts(RG.chunk_fixed(T.table(spark, d, "documents")))
)


@query("chunk_recursive")
def chunk_recursive(spark, d):
    return RG.chunk(T.table(spark, d, "documents"))


@query("topk_vectors", sql("", """
WITH c AS (SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY 1)
SELECT query_id, vec_id, rank::INT AS rank, round(1 - (2 - 2 * cos) / sqrt(2), 4) AS score FROM (
  SELECT c.label AS query_id, e.vec_id, list_cosine_similarity(c.q, e.embedding::DOUBLE[]) AS cos,
         row_number() OVER (PARTITION BY c.label ORDER BY round(list_cosine_similarity(c.q, e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank FROM c, embeddings e) WHERE rank <= 3"""))
def topk_vectors(spark, d):
    """The three vectors closest to the mean vector of each label."""
    corpus = T.table(spark, d, "embeddings")
    parts = corpus.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    questions = parts.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("embedding"))
    return RG.top_k(questions, corpus)


@query("incident_context")
def incident_context(spark, d):
    chunks = cut(RG.chunk_fixed(T.table(spark, d, "documents")))
    return RG.incident_context(incidents(spark, d), chunks, RG.fit_vectors(chunks))


@query("learning_chunks")
def learning_chunks(spark, d):
    """Resolved conversations appended as learning documents."""
    told = T.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda e: e["text"]), "\n").alias("summary"))
    return RG.chunk(RG.learning_documents(told))


# -- datasets ----------------------------------------------------------------------------------------------------


@query("fault_overlay", sql("scen tel inc", """
WITH roles AS (
  SELECT scenario_id, start_time, end_time, CASE WHEN on_node THEN u ELSE l END AS entity_id, 'root' AS role FROM scen
  UNION ALL SELECT s.scenario_id, s.start_time, s.end_time, i.link_id, 'attached' FROM scen s JOIN inc i ON i.node_id = s.u WHERE on_node
  UNION ALL SELECT DISTINCT s.scenario_id, s.start_time, s.end_time, b.link_id, 'sibling' FROM scen s JOIN inc a ON a.link_id = s.l JOIN inc b ON b.node_id = a.node_id
    AND b.link_id <> a.link_id WHERE NOT on_node)
SELECT r.scenario_id, r.role, t.entity_id, t.metric, t.seq, round(CASE WHEN count(*) OVER w > 1
    THEN (row_number() OVER (PARTITION BY r.scenario_id, t.entity_id ORDER BY t.ts, t.seq) - 1) / (count(*) OVER w - 1) ELSE 0 END::DOUBLE, 6) AS share
FROM roles r JOIN tel t ON t.entity_id = r.entity_id AND t.ts >= r.start_time AND t.ts <= r.end_time WINDOW w AS (PARTITION BY r.scenario_id, t.entity_id)"""))
def fault_overlay(spark, d):
    """Which readings the scenarios cover, in what role, and how far into the window."""
    rows = DS.covered(T.telemetry(spark, d), T.scenarios(spark, d), T.links(spark, d))
    return rows.select("scenario_id", "role", "entity_id", "metric", "seq", F.round("share", 6).alias("share"))


@query("evaluation_report")
def evaluation_report(spark, d):
    """Train on the first 20 days, observe the rest, score against the scenarios of that time."""
    long = cut(T.telemetry(spark, d))
    train, test = long.where(F.col("ts") < F.lit(CUTOFF)), long.where(F.col("ts") >= F.lit(CUTOFF))
    late = T.scenarios(spark, d).where(F.col("start_time") >= F.lit(CUTOFF))
    return PE.evaluate(train, test, late, T.nodes(spark, d), cut(T.links(spark, d))).report


# -- streams -----------------------------------------------------------------------------------------------------


def event_stream(spark, d):
    """The event table as a stream of telemetry under a watermark."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return event_rows(events).withWatermark("ts", SP.WATERMARK)


STREAM_EWMA = sql("utel", """
SELECT entity_id, metric, seq, coalesce(len(h), 0) AS n_before, CASE WHEN len(h) > 0 THEN round(list_reduce(h, lambda a, x: {'m': a.m + (x.m - a.m) * (2.0::DOUBLE / 21),
  'v': (1 - 2.0::DOUBLE / 21) * (a.v + (2.0::DOUBLE / 21) * (x.m - a.m) * (x.m - a.m))}).m, 6) END AS mean_before
FROM (SELECT *, list({'m': value, 'v': 0.0::DOUBLE}) OVER (PARTITION BY entity_id, metric ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM utel)""")


@query("stream_ewma", STREAM_EWMA)
def stream_ewma(spark, d):
    rows = drain(SP.stream_ewma(event_stream(spark, d)))
    return rows.select("entity_id", "metric", "seq", "n_before", F.when(F.col("n_before") > 0, F.round("mean_before", 6)).alias("mean_before"))


@query("stream_ewma_anomalies", sql("uewh", "SELECT epoch_us(ts) AS ts_us, entity_id, metric, observed, expected, severity, confidence FROM uewh"))
def stream_ewma_anomalies(spark, d):
    return shown(drain(SP.stream_ewma_anomalies(event_stream(spark, d))))


@query("stream_history", sql("utel", """
SELECT entity_id, metric, generate_subscripts(h, 1)::INT AS place, unnest(h) AS value FROM (
  SELECT entity_id, metric, list(value ORDER BY ts DESC, seq DESC)[1:60] AS h FROM utel GROUP BY ALL)"""))
def stream_history(spark, d):
    rows = drain(SP.stream_history(event_stream(spark, d)))
    newest_first = F.posexplode(F.reverse("values")).alias("place", "value")
    return rows.select("entity_id", "metric", newest_first).withColumn("place", F.col("place") + 1)


RATE_LIMIT = sql("utel", """
WITH one AS (SELECT entity_id AS scope, list({'id': seq, 't': epoch_us(ts)} ORDER BY ts, seq) AS acts,
       list_reduce(list({'t': epoch_us(ts), 'taken': [epoch_us(ts)], 'said': [true]} ORDER BY ts, seq), lambda a, x: {
         't': x.t, 'taken': CASE WHEN len(list_filter(a.taken, lambda v: v >= x.t - 36000000000)) < 3 THEN list_append(a.taken, x.t) ELSE a.taken END,
         'said': list_append(a.said, len(list_filter(a.taken, lambda v: v >= x.t - 36000000000)) < 3)}).said AS said
     FROM utel WHERE metric = 'throughput_gbps' GROUP BY 1)
SELECT act.id AS action_id, act.t AS ts_us, scope, accepted FROM (SELECT scope, unnest(acts) AS act, unnest(said) AS accepted FROM one)""")


@query("stream_rate_limit", RATE_LIMIT)
def stream_rate_limit(spark, d):
    """Purchases are actions on a user; at most three per user in ten hours are accepted."""
    actions = event_stream(spark, d).where("metric = 'throughput_gbps'").select(F.col("seq").alias("action_id"), "ts", F.col("entity_id").alias("scope"))
    return drain(SP.stream_rate_limit(actions, minutes=600)).select("action_id", micros(), "scope", "accepted")


STREAM_LIFECYCLE = sql("utel", f"""
WITH hit AS (SELECT *, epoch_us(ts) // 86400000000 AS cycle, value / lim AS ratio FROM (
    SELECT *, CASE metric WHEN 'utilization_pct' THEN 85.0::DOUBLE WHEN 'packet_loss_pct' THEN 1.0::DOUBLE WHEN 'cpu_pct' THEN 90.0::DOUBLE
                          WHEN 'latency_ms' THEN 12.5::DOUBLE END AS lim FROM utel) WHERE value > lim),
sev AS (SELECT *, CASE WHEN ratio >= 1.3 THEN 'critical' WHEN ratio >= 1.1 THEN 'high' ELSE 'medium' END AS severity FROM hit),
mark AS (SELECT (epoch_us(max(ts)) - 300000000) // 86400000000 AS passed FROM utel),
peak AS (SELECT cycle, entity_id, metric, max_by(severity, {{'r': {RANK.format('severity')}, 's': seq}}) AS severity, 0.7::DOUBLE AS confidence
         FROM sev GROUP BY 1, 2, 3),
cyc AS (SELECT p.* FROM peak p, mark WHERE cycle < passed),
seen AS (SELECT *, lag(cycle) OVER w AS before, lag(severity) OVER w AS was, lead(cycle) OVER w AS after FROM cyc
         WINDOW w AS (PARTITION BY entity_id, metric ORDER BY cycle))
SELECT entity_id, metric, cycle, severity, confidence,
       CASE WHEN before IS NULL OR before <> cycle - 1 THEN 'new' WHEN severity <> was THEN 'changed' ELSE 'unchanged' END AS change FROM seen
UNION ALL SELECT entity_id, metric, cycle + 1, severity, confidence, 'resolved' FROM seen, mark
WHERE (after IS NULL OR after <> cycle + 1) AND cycle + 1 < passed""")


@query("stream_lifecycle", STREAM_LIFECYCLE)
def stream_lifecycle(spark, d):
    """Daily lifecycle of threshold anomalies, from the event stream."""
    long = event_stream(spark, d)
    found = D.threshold()(long).withColumn("cycle", day())
    return drain(SP.stream_lifecycle(found.select("ts", "cycle", "entity_id", "metric", "severity", "confidence", "seq"), 86400))


@query("stream_monitor", sql("utel", """
SELECT 'A' || a.seq AS action_id, epoch_us(t.ts) AS ts_us, t.value FROM utel a JOIN utel t ON t.entity_id = a.entity_id AND t.metric = a.metric
AND t.ts > a.ts AND t.ts <= a.ts + INTERVAL 2880 MINUTE WHERE a.metric = 'throughput_gbps' AND a.value > 0 AND t.value < a.value * 0.8::DOUBLE"""))
def stream_monitor(spark, d):
    """Throughput readings within two days that fall 20 % below an earlier one."""
    actions = event_stream(spark, d).where("metric = 'throughput_gbps'").select(
        F.concat(F.lit("A"), "seq").alias("action_id"), "ts", "entity_id", "metric", F.col("value").alias("pre"))
    return drain(SP.stream_monitor(actions, event_stream(spark, d), 2880)).select("action_id", micros(), "value")


@query("stream_approvals", sql("utel", """
SELECT 'A' || a.seq AS action_id, epoch_us(p.ts) AS approved_us, 'approved' AS status FROM utel a JOIN utel p ON p.metric = 'cpu_pct' AND p.entity_id = a.entity_id
AND p.ts >= a.ts AND p.ts <= a.ts + INTERVAL 24 HOUR WHERE a.metric = 'throughput_gbps'
UNION ALL SELECT 'A' || a.seq, 0, 'expired' FROM utel a WHERE a.metric = 'throughput_gbps'
AND NOT EXISTS (SELECT 1 FROM utel p WHERE p.metric = 'cpu_pct' AND p.entity_id = a.entity_id AND p.ts >= a.ts AND p.ts <= a.ts + INTERVAL 24 HOUR)
AND a.ts + INTERVAL 24 HOUR + INTERVAL 5 MINUTE < (SELECT least(max(ts) FILTER (metric = 'throughput_gbps'), max(ts) FILTER (metric = 'cpu_pct')) FROM utel)"""))
def stream_approvals(spark, d):
    """Purchases wait up to a day for a signup of the same user as approval; those that the watermark has passed expire."""
    held = event_stream(spark, d).where("metric = 'throughput_gbps'").select(F.col("entity_id").alias("action_id"), "ts", "seq")
    said = event_stream(spark, d).where("metric = 'cpu_pct'").select(F.col("entity_id").alias("action_id"), "ts", F.col("seq").alias("operator"))
    rows = drain(SP.stream_approvals(held, said, 24))
    own = T.table(spark, d, "events").where("event_type = 'purchase'").select(F.concat(F.lit("U"), "user_id").alias("action_id"), "ts", "event_id")
    return rows.join(own, ["action_id", "ts"]).select(
        F.concat(F.lit("A"), "event_id").alias("action_id"), F.coalesce(F.unix_micros("approved_ts"), F.lit(0)).alias("approved_us"), "status")


def arriving_stream(spark, d):
    """The events as they arrive in micro-batches of five days, some one or two batches later, some twice."""
    rows = T.table(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("U"), F.col("user_id")).alias("entity_id"),
        F.when(F.col("event_type") == "signup", "node").otherwise("link").alias("entity_type"),
        I.lookup(T.EVENT_METRIC, F.col("event_type")).alias("metric"), "value", F.col("event_id").alias("seq"))
    first = rows.agg(F.min(F.unix_date(F.to_date("ts")))).scalar()
    later = F.when(F.col("seq") % 23 == 0, 2).when(F.col("seq") % 29 == 0, 1).otherwise(0)
    rows = rows.withColumn("batch", F.floor((F.unix_date(F.to_date("ts")) - first) / 5) + later)
    rows = rows.withColumn("_copy", F.explode(F.when(F.col("seq") % 19 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_copy")
    folder = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    io.write_batches(rows, folder, "batch", files=4)
    schema = rows.drop("batch").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder).withWatermark("ts", "2 days")


@query("stream_delivery", sql("arr", "SELECT seq, entity_id, metric, value FROM arr"))
def stream_delivery(spark, d):
    """All arrivals, late and repeated ones too, kept by batch number."""
    folder = f"{shared_dir(spark)}/delivery-{uuid.uuid4().hex}"
    body = io.fan_out({"table": io.batch_table(f"{folder}/table")})
    writer = arriving_stream(spark, d).writeStream.foreachBatch(body).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("seq", "entity_id", "metric", "value")


@query("stream_late", sql("arr marks", """
SELECT seq, epoch_us(ts) <= mark * 1000 AS late, count(*) AS copies FROM arr JOIN marks USING (batch) GROUP BY ALL"""))
def stream_late(spark, d):
    """Which readings the watermark had passed when they came, over eight micro-batches."""
    return drain(SP.mark_late(arriving_stream(spark, d))).groupBy("seq", "late").agg(F.count("*").alias("copies"))


@query("stream_observe", sql("aens arr", f"""WITH peaks AS (
SELECT epoch_us(ts) // 86400000000 AS cycle, entity_id, metric, max_by({{'observed': observed, 'severity': severity, 'confidence': confidence, 'detector': detector, 'seq': seq}},
       {{'r': {RANK.format('severity')}, 'c': confidence, 's': seq}}) AS b FROM aens GROUP BY ALL),
cyc AS (SELECT cycle, entity_id, metric, b.observed AS observed, b.severity AS severity, b.confidence AS confidence, b.detector AS detector FROM peaks
        WHERE cycle < (SELECT (max(epoch_us(ts) // 1000) - 172800000) // 86400000 FROM arr))
SELECT c.*, CASE WHEN p.severity IS NULL THEN 'new' WHEN c.severity <> p.severity OR round(abs(c.confidence - p.confidence), 6) >= 0.05 THEN 'changed' ELSE 'unchanged' END AS change
FROM cyc c LEFT JOIN cyc p ON p.cycle = c.cycle - 1 AND p.entity_id = c.entity_id AND p.metric = c.metric"""))
def stream_observe(spark, d):
    """Daily cycles of thresholds and moving averages with their changes, from readings that come late, out of order and twice."""
    folder = f"{shared_dir(spark)}/observe-{uuid.uuid4().hex}"
    SO.stream_observe(arriving_stream(spark, d), None, folder, period_seconds=86400, predict=False).awaitTermination()
    return SO.observed(spark, folder).select("cycle", "entity_id", "metric", "observed", "severity", "confidence", "detector", "change")


@query("active_scenarios", sql("scen", """
SELECT e.event_id, s.scenario_id FROM events e JOIN scen s ON e.ts >= s.start_time AND e.ts <= s.end_time"""))
def active_scenarios(spark, d):
    ticks = event_stream(spark, d).select("ts", F.col("seq").alias("event_id"))
    return drain(SP.active_scenarios(ticks, T.scenarios(spark, d))).select("event_id", "scenario_id")



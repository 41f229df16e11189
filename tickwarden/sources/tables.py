"""The star-schema and event tables read as telemetry, topology, scenario and action tables.

events      -> telemetry: one metric per event type; the node `U<user>` and its access link `N<nation>-U<user>`
region,
nation,
customer    -> topology: regions are core, nations aggregation, users that emit events are edge nodes
events      -> scenarios: every error reading above 200 opens a 45-minute incident on the user's access link
orders,
lineitem    -> actions and their results: an order is the action, the customer's previous order its "before"
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickwarden.functions.ids import link_id, lookup
from tickwarden.operators.series import over_series

# How table codes are read as domain terms.
EVENT_METRIC = {
    "click": "utilization_pct",
    "view": "latency_ms",
    "error": "packet_loss_pct",
    "purchase": "throughput_gbps",
    "signup": "cpu_pct",
}
PRIORITY_ACTION = {
    "1-URGENT": "reroute",
    "2-HIGH": "rate_limit",
    "3-MEDIUM": "config_rollback",
    "4-NOT SPECIFIED": "escalate",
    "5-LOW": "create_ticket",
}
SEGMENT_SCENARIO = {
    "AUTOMOBILE": "congestion_cascade",
    "BUILDING": "hardware_degradation",
    "FURNITURE": "ddos_surge",
    "HOUSEHOLD": "misconfiguration",
    "MACHINERY": "fiber_cut",
}
SCENARIO_CYCLE = ("congestion_cascade", "hardware_degradation", "ddos_surge", "misconfiguration", "fiber_cut")


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its zoneless times read as UTC instants. A path's schema is read from its files once."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    rows = spark.read.schema(_schemas[path]).parquet(path)
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active users with the nation their access link ends in."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    return users.join(customers, "user_id")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long telemetry: ts, entity_id, entity_type, metric, value, seq."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type", "value")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    user = F.concat(F.lit("U"), F.col("user_id"))
    access = F.concat(F.lit("N"), F.col("c_nationkey"), F.lit("-U"), F.col("user_id"))
    node = F.col("event_type") == "signup"
    return events.join(customers, "user_id").select(
        "ts",
        F.when(node, user).otherwise(access).alias("entity_id"),
        F.when(node, "node").otherwise("link").alias("entity_type"),
        lookup(EVENT_METRIC, F.col("event_type")).alias("metric"),
        "value",
        F.col("event_id").alias("seq"),
    )


def user_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry keyed by the user node only; no join, for operators that need no topology."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "ts",
        F.concat(F.lit("U"), F.col("user_id")).alias("entity_id"),
        F.when(F.col("event_type") == "signup", "node").otherwise("link").alias("entity_type"),
        lookup(EVENT_METRIC, F.col("event_type")).alias("metric"),
        "value",
        F.col("event_id").alias("seq"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, node_type, region, capacity_gbps, customers (orders placed by the user)."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    core = regions.select(
        F.concat(F.lit("R"), "r_regionkey").alias("node_id"), F.lit("core").alias("node_type"),
        F.col("r_name").alias("region"), F.lit(400.0).alias("capacity_gbps"), F.lit(0).cast("long").alias("customers"),
    )
    named = nations.join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))
    aggregation = named.select(
        F.concat(F.lit("N"), "n_nationkey").alias("node_id"), F.lit("aggregation").alias("node_type"),
        F.col("r_name").alias("region"), F.lit(100.0).alias("capacity_gbps"), F.lit(0).cast("long").alias("customers"),
    )
    placed = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("customers"))
    users = homes(spark, sf_dir).join(placed, "user_id", "left")
    edge = users.join(F.broadcast(named), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("U"), "user_id").alias("node_id"), F.lit("edge").alias("node_type"),
        F.col("r_name").alias("region"), F.lit(40.0).alias("capacity_gbps"),
        F.coalesce("customers", F.lit(0)).cast("long").alias("customers"),
    )
    return core.unionByName(aggregation).unionByName(edge)


def backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core mesh, region-nation links and a chain through the nations of each region."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    a, b = regions.select(F.col("r_regionkey").alias("a")), regions.select(F.col("r_regionkey").alias("b"))
    core = a.join(b, F.col("a") < F.col("b")).select(
        F.concat(F.lit("R"), "a").alias("s"), F.concat(F.lit("R"), "b").alias("t"),
        F.lit(200.0).alias("capacity_gbps"), F.lit(5.0).alias("latency_baseline_ms"),
    )
    up = nations.select(
        F.concat(F.lit("R"), "n_regionkey").alias("s"), F.concat(F.lit("N"), "n_nationkey").alias("t"),
        F.lit(100.0).alias("capacity_gbps"), F.lit(2.0).alias("latency_baseline_ms"),
    )
    later = nations.select(F.col("n_regionkey"), F.col("n_nationkey").alias("other"))
    chain = nations.join(later, "n_regionkey").where(F.col("other") > F.col("n_nationkey"))
    chain = chain.groupBy("n_nationkey").agg(F.min("other").alias("other")).select(
        F.concat(F.lit("N"), "n_nationkey").alias("s"), F.concat(F.lit("N"), "other").alias("t"),
        F.lit(40.0).alias("capacity_gbps"), F.lit(1.0).alias("latency_baseline_ms"),
    )
    return core.unionByName(up).unionByName(chain)


def access_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return homes(spark, sf_dir).select(
        F.concat(F.lit("N"), "c_nationkey").alias("s"), F.concat(F.lit("U"), "user_id").alias("t"),
        F.lit(40.0).alias("capacity_gbps"),
        (F.lit(20.0) + F.col("c_nationkey") * 2.0).alias("latency_baseline_ms"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link_id, source, target, capacity_gbps, latency_baseline_ms, weight."""
    both = backbone(spark, sf_dir).unionByName(access_links(spark, sf_dir))
    return both.select(
        link_id(F.col("s"), F.col("t")).alias("link_id"), F.col("s").alias("source"), F.col("t").alias("target"),
        "capacity_gbps", "latency_baseline_ms", F.lit(1.0).alias("weight"),
    )


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest value per (entity, metric)."""
    return telemetry(spark, sf_dir).groupBy("entity_id", "entity_type", "metric").agg(
        F.max_by("value", F.struct("ts", "seq")).alias("value")
    )


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("value") > 200.0))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    kind = F.element_at(F.array(*[F.lit(s) for s in SCENARIO_CYCLE]), (F.col("user_id") % 5 + 1).cast("int"))
    user, nation = F.concat(F.lit("U"), "user_id"), F.concat(F.lit("N"), "c_nationkey")
    on_node = F.col("scenario_type").isin("hardware_degradation", "ddos_surge")
    rows = events.join(customers, "user_id").withColumn("scenario_type", kind)
    return rows.select(
        F.concat(F.lit("SC"), "event_id").alias("scenario_id"),
        "scenario_type",
        F.col("ts").alias("start_time"),
        (F.col("ts") + F.expr("INTERVAL 45 MINUTES")).alias("end_time"),
        F.when(F.col("value") > 300, "critical").when(F.col("value") > 250, "high").otherwise("medium").alias("severity"),
        F.concat_ws(" on ", "scenario_type", F.when(on_node, user).otherwise(F.concat_ws("-", nation, user))).alias("root_cause"),
        F.when(on_node, user).alias("root_cause_node"),
        F.when(~on_node, F.concat_ws("-", nation, user)).alias("root_cause_link"),
        F.when(on_node, F.array(user)).otherwise(F.array(nation, user)).alias("affected_nodes"),
        F.array(F.concat_ws("-", nation, user)).alias("affected_links"),
    )


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One action per order that has an earlier order of the same customer; before/after values of three metrics."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("qty"), F.max("l_discount").alias("disc")
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    placed = orders.join(lines, "o_orderkey", "left").join(customers, "o_custkey")
    placed = placed.withColumns({"qty": F.coalesce("qty", F.lit(0.0)), "disc": F.coalesce("disc", F.lit(0.0))})
    pairs = over_series(
        placed, ["o_custkey"], ["o_orderdate", "o_orderkey"],
        lambda w: {
            "pre_price": F.lag("o_totalprice").over(w),
            "pre_qty": F.lag("qty").over(w),
            "pre_disc": F.lag("disc").over(w),
        },
        before=1, sized_by=orders,
    ).where(F.col("pre_price").isNotNull())
    return pairs.select(
        F.concat(F.lit("A"), "o_orderkey").alias("action_id"),
        F.col("o_orderdate").alias("ts"),
        "o_custkey",
        lookup(PRIORITY_ACTION, F.col("o_orderpriority")).alias("action_type"),
        lookup(SEGMENT_SCENARIO, F.col("c_mktsegment")).alias("scenario_type"),
        (F.col("pre_price") / 1000).alias("pre_latency"), (F.col("o_totalprice") / 1000).alias("post_latency"),
        F.col("pre_qty").alias("pre_util"), F.col("qty").alias("post_util"),
        (F.col("pre_disc") * 100).alias("pre_loss"), (F.col("disc") * 100).alias("post_loss"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action log in long form: action_id, ts, action_type, scenario_type, key, pre, post."""
    entries = F.array(
        F.struct(F.lit("link.latency_ms").alias("key"), F.col("pre_latency").alias("pre"), F.col("post_latency").alias("post")),
        F.struct(F.lit("link.utilization_pct").alias("key"), F.col("pre_util").alias("pre"), F.col("post_util").alias("post")),
        F.struct(F.lit("link.packet_loss_pct").alias("key"), F.col("pre_loss").alias("pre"), F.col("post_loss").alias("post")),
    )
    return action_log(spark, sf_dir).select("action_id", "ts", "action_type", "scenario_type", F.inline(entries))


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hypothesis per scenario, named after its root and worded from its severity and type."""
    rows = scenarios(spark, sf_dir).join(
        table(spark, sf_dir, "events").select(F.concat(F.lit("SC"), "event_id").alias("scenario_id"), "value"), "scenario_id"
    )
    root = F.coalesce("root_cause_node", "root_cause_link")
    words = F.replace(F.col("scenario_type"), F.lit("_"), F.lit(" "))
    short = F.when(F.col("root_cause_node").isNotNull(), "cpu").otherwise("utilization")
    return rows.select(
        F.col("scenario_id").alias("incident_id"), F.col("scenario_id").alias("hypothesis_id"),
        F.format_string("A %s %s is likely at %s", "severity", words, root).alias("description"),
        F.concat_ws("_", root, short).alias("root_cause"),
        F.round(F.least(F.lit(0.99), F.col("value") / 400), 4).alias("confidence"),
        F.array(F.format_string("packet_loss_pct=%.2f on %s", "value", F.try_element_at("affected_links", F.lit(1)))).alias("evidence"),
        "affected_nodes", "affected_links",
        F.array(F.concat(F.lit("Investigate "), root)).alias("recommended_actions"),
    )


def link_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every link of a scenario with a utilisation reading: reroute to its alternate, rate limit, scale, roll back."""
    from tickwarden.operators.topology import alternate_link
    from tickwarden.operators.whatif import parameters

    network = links(spark, sf_dir)
    used = state(spark, sf_dir).where(F.col("metric") == "utilization_pct").select(F.col("entity_id").alias("link_id"))
    hit = scenarios(spark, sf_dir).select(F.explode("affected_links").alias("link_id")).distinct()
    rows = network.select("link_id", "capacity_gbps").join(used, "link_id").join(hit, "link_id").join(alternate_link(network), "link_id", "left")
    kinds = F.array(*[F.lit(k) for k in ("reroute", "rate_limit", "scale_capacity", "config_rollback")])
    rows = rows.withColumn("action_type", F.explode(kinds))
    return rows.select(
        F.concat_ws("/", "link_id", "action_type").alias("action_id"), "action_type",
        F.lit(None).cast("string").alias("target_node"), F.col("link_id").alias("target_link"),
        parameters(F.col("action_type"), F.col("link_id"), F.col("alternate"), F.col("capacity_gbps"), F.lit("")).alias("parameters"),
    )


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns read as opinions on a decision."""
    turns = table(spark, sf_dir, "conversations")
    role = F.element_at(F.array(F.lit("reliability"), F.lit("performance"), F.lit("cost_sla")), (F.col("turn") % 3 + 1).cast("int"))
    return turns.select(
        F.col("conv_id").cast("string").alias("action_id"), F.col("turn").alias("seq"), role.alias("agent_role"),
        F.when(F.col("role") == "user", "support").when(F.col("role") == "assistant", "oppose").otherwise("conditional").alias("position"),
        F.col("text").alias("argument"), (F.length("text") % 100 / 100).alias("confidence"),
        F.array().cast("array<string>").alias("conditions"),
    )

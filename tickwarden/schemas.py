"""Record contracts and the fixed values the rules are stated in."""

from __future__ import annotations

from pyspark.sql import types as T

# Metric names, limits and label sets that results depend on.
NODE_METRICS = ("cpu_pct", "memory_pct", "temperature_c", "buffer_drops")
LINK_METRICS = ("utilization_pct", "latency_ms", "packet_loss_pct", "throughput_gbps")
METRICS = NODE_METRICS + LINK_METRICS

SHORT_NAME = {
    "utilization_pct": "utilization",
    "packet_loss_pct": "packet_loss",
    "latency_ms": "latency",
    "cpu_pct": "cpu",
    "temperature_c": "temperature",
    "buffer_drops": "buffer_drops",
    "memory_pct": "memory",
    "throughput_gbps": "throughput",
}

THRESHOLDS = {
    "utilization_pct": 85.0,
    "packet_loss_pct": 1.0,
    "cpu_pct": 90.0,
    "temperature_c": 70.0,
    "buffer_drops": 100.0,
    "memory_pct": 85.0,
    "throughput_gbps": float("inf"),
}
LATENCY_FACTOR = 2.5
DEFAULT_LATENCY_MS = 5.0
FORECAST_LIMITS = {
    "utilization_pct": 85.0,
    "cpu_pct": 90.0,
    "memory_pct": 85.0,
    "temperature_c": 70.0,
}
# Metrics that get worse as they rise; throughput gets worse as it falls.
RISING_IS_WORSE = (
    "latency_ms",
    "utilization_pct",
    "packet_loss_pct",
    "cpu_pct",
    "memory_pct",
    "temperature_c",
    "buffer_drops",
)
FALLING_IS_WORSE = ("throughput_gbps",)

SEVERITIES = ("low", "medium", "high", "critical")
NODE_TYPES = ("core", "aggregation", "edge", "peering")
NODE_STATUS = ("healthy", "degraded", "critical", "down")
LINK_STATUS = ("healthy", "degraded", "congested", "down")
TIER = {"peering": 0, "core": 1, "aggregation": 2, "edge": 3}
ACTION_TYPES = ("reroute", "rate_limit", "scale_capacity", "config_rollback", "create_ticket", "escalate")
PASSIVE_ACTIONS = ("create_ticket", "escalate")
OUTCOMES = ("effective", "partially_effective", "ineffective", "harmful")
SCENARIO_TYPES = ("congestion_cascade", "hardware_degradation", "ddos_surge", "misconfiguration", "fiber_cut")

_text, _num, _when = T.StringType(), T.DoubleType(), T.TimestampType()
_texts, _metric_map = T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.DoubleType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


TELEMETRY_WIDE = T.StructType(
    [
        T.StructField("timestamp", _when, False),
        T.StructField("entity_id", _text, False),
        T.StructField("entity_type", _text, False),
    ]
    + [T.StructField(m, _num, True) for m in METRICS + ("capacity_gbps", "latency_baseline_ms")]
)
TELEMETRY_LONG = _struct(ts=_when, entity_id=_text, entity_type=_text, metric=_text, value=_num, seq=T.LongType())
SNAPSHOT = _struct(
    timestamp=_text,
    nodes=T.MapType(T.StringType(), _metric_map),
    links=T.MapType(T.StringType(), _metric_map),
)
NODES = _struct(
    node_id=_text, node_type=_text, region=_text, capacity_gbps=_num, cpu_baseline=_num,
    temp_baseline=_num, memory_baseline=_num, customers=T.LongType(),
)
LINKS = _struct(
    link_id=_text, source=_text, target=_text, capacity_gbps=_num,
    latency_baseline_ms=_num, distance_km=_num, weight=_num,
)
ANOMALIES = _struct(
    ts=_when, entity_id=_text, metric=_text, observed=_num, expected=_num,
    severity=_text, confidence=_num, detector=_text, seq=T.LongType(),
)
SCENARIOS = _struct(
    scenario_id=_text, scenario_type=_text, split=_text, start_time=_when, end_time=_when, severity=_text,
    root_cause=_text, root_cause_node=_text, root_cause_link=_text, affected_nodes=_texts,
    affected_links=_texts, description=_text,
)
GROUND_TRUTH = _struct(
    ts=_when, is_anomaly=T.BooleanType(), scenario_type=_text, root_cause=_text, severity=_text,
    affected_entities=_texts,
)
CAUSAL_EDGES = _struct(src=_text, dst=_text, strength=_num, edge_type=_text)
HYPOTHESES = _struct(
    incident_id=_text, description=_text, root_cause=_text, confidence=_num, evidence=_texts,
    affected_nodes=_texts, affected_links=_texts, recommended_actions=_texts,
)
ACTIONS = _struct(
    action_id=_text, action_type=_text, target_node=_text, target_link=_text,
    parameters=T.MapType(T.StringType(), T.StringType()), expected_impact=_text, risk_level=_num,
    requires_approval=T.BooleanType(), utility_score=_num, verified=T.BooleanType(), proof=_text,
)
ACTION_RESULTS = _struct(
    action_id=_text, success=T.BooleanType(), pre_metrics=_metric_map, post_metrics=_metric_map,
    rollback_available=T.BooleanType(), rollback_token=_text, outcome=_text,
)
AUDIT = _struct(
    ts=_when, decision_id=_text, phase=_text, rationale=_text, operator_approved=T.BooleanType(), outcome=_text,
)
OPINIONS = _struct(
    action_id=_text, agent_role=_text, position=_text, argument=_text, confidence=_num, conditions=_texts,
)
DETECTION_SAMPLES = _struct(
    entity_id=_text, metric=_text, observed_value=_num, expected_value=_num, label=T.IntegerType(),
    scenario_type=_text,
)
TRAINING_ROWS = _struct(anomaly_type=_text, action_type=_text, outcome=_text)
MESSAGES = T.ArrayType(_struct(role=_text, content=_text))
CONVERSATIONS = _struct(messages=MESSAGES, metadata=T.MapType(T.StringType(), T.StringType()))

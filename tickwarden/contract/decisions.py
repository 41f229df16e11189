"""What-if, safety, outcome and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwarden.contract.detection import day, ensemble_rows, micros
from tickwarden.contract.network import ALTERNATE, DIRS, EDGES, graph
from tickwarden.contract.registry import query, sql
from tickwarden.operators import context as X
from tickwarden.operators import datasets as DS
from tickwarden.operators import outcomes as O
from tickwarden.operators import safety as S
from tickwarden.operators import whatif as W
from tickwarden.operators.causal import propagate
from tickwarden.operators.topology import customer_impact
from tickwarden.plans.decision import decide
from tickwarden.session import cut
from tickwarden.sources import tables as T

# -- candidate actions -------------------------------------------------------------------------------------------

# Lower-cased text every hypothesis is classified by; "down" also stands inside longer words.
CANDIDATES = f"""txt AS (SELECT *, lower(description || ' ' || root_cause || ' ' || evidence || ' Investigate ' || CASE WHEN on_node THEN u ELSE l END) AS t,
  lower(description || ' ' || evidence) AS t2 FROM hyp),
cls AS (SELECT *, CASE WHEN regexp_matches(t, 'ddos|surge|flood|attack') THEN 'ddos' WHEN regexp_matches(t, 'misconfig|configuration|rollback|route leak') THEN 'misconfiguration'
    WHEN regexp_matches(t, 'link down|fiber cut|down|disconnected') THEN 'link_down' WHEN regexp_matches(t, 'hardware|temperature|cpu|memory|buffer') THEN 'hardware' ELSE 'congestion' END AS class,
  CASE WHEN contains(t2, 'critical') THEN 'critical' WHEN contains(t2, 'high') THEN 'high' WHEN contains(t2, 'low') THEN 'low' ELSE 'medium' END AS sev FROM txt),
alt AS ({ALTERNATE}),
cand AS (SELECT *, hypothesis_id || '/' || action_type AS action_id, action_type IN ('reroute', 'rate_limit', 'scale_capacity') AS lk,
  CASE sev WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.4 ELSE 0.1 END::DOUBLE AS pen,
  CASE WHEN on_node THEN u END AS root_node, CASE WHEN NOT on_node THEN l END AS root_link FROM (
    SELECT *, unnest(CASE class WHEN 'ddos' THEN ['rate_limit', 'escalate'] WHEN 'misconfiguration' THEN ['config_rollback', 'create_ticket']
      WHEN 'link_down' THEN ['reroute', 'escalate'] WHEN 'hardware' THEN ['escalate', 'create_ticket'] ELSE ['reroute', 'rate_limit'] END) AS action_type FROM cls)),
risky AS (SELECT *, CASE WHEN lk THEN coalesce(root_link, l) END AS target_link, CASE WHEN NOT lk THEN root_node END AS target_node,
  least(1.0, CASE action_type WHEN 'reroute' THEN 0.55 WHEN 'rate_limit' THEN 0.35 WHEN 'config_rollback' THEN 0.6 WHEN 'escalate' THEN 0.15 ELSE 0.05 END::DOUBLE
    + (1 - confidence) * 0.2::DOUBLE + pen * 0.25::DOUBLE) AS risk_level FROM cand)"""
IMPACT = """hit AS (SELECT DISTINCT hypothesis_id, unnest([u, n]) AS node_id FROM hyp),
imp AS (SELECT hypothesis_id, least(1.0, sum(customers) / (SELECT sum(customers) FROM nodes)) AS impact FROM hit JOIN nodes USING (node_id) GROUP BY 1)"""
UTILITY = """useful AS (SELECT r.*, round(-(impact * pen)
  - CASE action_type WHEN 'reroute' THEN 0.3::DOUBLE * 0.4 WHEN 'rate_limit' THEN 0.2::DOUBLE * 0.2 WHEN 'config_rollback' THEN 0.4::DOUBLE * 0.5 ELSE 0.0 END
  + confidence * CASE action_type WHEN 'reroute' THEN 0.7 WHEN 'rate_limit' THEN 0.68 WHEN 'config_rollback' THEN 0.72 WHEN 'escalate' THEN 0.45 ELSE 0.25 END::DOUBLE * pen, 6) AS utility_score
  FROM risky r JOIN imp USING (hypothesis_id))"""


def candidate_rows(spark, d):
    return W.candidates(T.hypotheses(spark, d), cut(T.links(spark, d)))


def useful_rows(spark, d):
    impact = customer_impact(W.affected_entities(T.hypotheses(spark, d)), T.nodes(spark, d), "hypothesis_id")
    return W.utility(candidate_rows(spark, d), impact)


query("candidate_actions", sql("hyp links inc", f"""WITH {CANDIDATES}
SELECT r.action_id, action_type, class AS hypothesis_class, sev AS text_severity, target_link, target_node, round(risk_level, 6) AS risk_level,
       CASE WHEN action_type = 'reroute' THEN a.alternate END AS to_link FROM risky r LEFT JOIN alt a ON a.link_id = coalesce(root_link, l)"""))(
    lambda spark, d: candidate_rows(spark, d).select(
        "action_id", "action_type", "hypothesis_class", "text_severity", "target_link", "target_node", F.round("risk_level", 6).alias("risk_level"),
        F.try_element_at("parameters", F.lit("to_link")).alias("to_link"))
)
query("utility_rank", sql("hyp links inc nodes", f"""WITH {CANDIDATES}, {IMPACT}, {UTILITY}
SELECT hypothesis_id, action_id, utility_score, row_number() OVER (PARTITION BY hypothesis_id ORDER BY utility_score DESC, action_id)::INT AS rank FROM useful"""))(
    lambda spark, d: W.rank_actions(useful_rows(spark, d).withColumn("is_safe", F.lit(True)), "hypothesis_id").select("hypothesis_id", "action_id", "utility_score", "rank")
)
query("decision_policy", sql("hyp links inc", f"""WITH {CANDIDATES}
SELECT action_id, CASE WHEN confidence < 0.6 THEN 'create_ticket' ELSE action_type END AS decided_type,
       CASE WHEN confidence < 0.6 THEN false WHEN risk_level >= 0.7 THEN true WHEN risk_level < 0.4 THEN false ELSE confidence < 0.85 END AS requires_approval,
       risk_level >= 0.7 OR (action_type IN ('reroute', 'config_rollback') AND confidence < 0.85) AS needs_review FROM risky"""))(
    lambda spark, d: W.policy(candidate_rows(spark, d)).select(
        "action_id", "decided_type", "requires_approval",
        W.needs_review(F.col("action_type"), F.col("risk_level"), F.col("confidence")).alias("needs_review"))
)
query("action_payloads", sql("hyp links inc", f"""WITH {CANDIDATES}
SELECT action_id, CASE action_type
  WHEN 'reroute' THEN '{{"action_type":"reroute","source_node":"' || split_part(target_link, '-', 1) || '","target_node":"' || split_part(target_link, '-', 2) || '","new_weight":8.0}}'
  WHEN 'rate_limit' THEN '{{"action_type":"rate_limit","target_link":"' || target_link || '","limit_pct":70.0}}' END AS payload FROM risky WHERE action_type IN ('reroute', 'rate_limit')"""))(
    lambda spark, d: candidate_rows(spark, d).where("action_type IN ('reroute', 'rate_limit')").select(
        "action_id", W.engine_payload(F.col("action_type"), F.col("parameters"), F.col("target_link")).alias("payload"))
)
query("action_entities", sql("hyp links inc", f"""WITH {CANDIDATES}
SELECT DISTINCT action_id, e AS entity_id FROM (
  SELECT action_id, unnest(list_concat([target_node, target_link], list_concat(string_split(target_link, '-'),
    CASE WHEN action_type = 'reroute' THEN list_concat([a.alternate], string_split(a.alternate, '-')) END))) AS e
  FROM risky LEFT JOIN alt a ON a.link_id = coalesce(root_link, l)) WHERE e IS NOT NULL"""))(
    lambda spark, d: W.action_entities(candidate_rows(spark, d))
)


@query("action_briefs")
def action_briefs(spark, d):
    return X.action_brief(candidate_rows(spark, d).drop("description", "confidence", "evidence"), T.hypotheses(spark, d))


query("decision_rationale", sql("hyp links inc nodes", f"""WITH {CANDIDATES}, {IMPACT}, {UTILITY}
SELECT action_id AS decision_id, 'decide' AS phase,
       printf('Selected action ''%s'' for root cause ''%s'' with utility=%.3f, risk=%.2f, verified=true.', action_type, root_cause, utility_score, risk_level) AS rationale FROM useful"""))(
    lambda spark, d: X.decision_rationale(
        useful_rows(spark, d).withColumns({"verified": F.lit(True), "ts": F.lit(None).cast("timestamp")})
    ).select("decision_id", "phase", "rationale")
)

# -- effects -----------------------------------------------------------------------------------------------------

LINKACTS = f"""alt AS ({ALTERNATE}),
wa AS (SELECT u.link_id, u.value AS util, a.alternate, k AS action_type, u.link_id || '/' || k AS action_id, l.capacity_gbps, l.source, l.target
  FROM util u JOIN links l USING (link_id) LEFT JOIN alt a USING (link_id), (SELECT unnest(['reroute', 'rate_limit', 'scale_capacity', 'config_rollback']) AS k)
  WHERE u.link_id IN (SELECT l FROM scen))"""
DELTAS = """d0 AS (SELECT action_id, link_id || '_utilization' AS variable,
    -(CASE action_type WHEN 'reroute' THEN util * 0.3::DOUBLE ELSE least(20.0::DOUBLE, util) END) AS delta FROM wa WHERE action_type IN ('reroute', 'rate_limit')
  UNION ALL SELECT action_id, alternate || '_utilization', util * 0.3::DOUBLE FROM wa WHERE action_type = 'reroute' AND alternate IS NOT NULL)"""


def rounds(n: int = 4) -> str:
    parts = ["f1 AS (SELECT action_id, variable, sum(delta) AS delta FROM d0 GROUP BY 1, 2)"]
    for k in range(1, n + 1):
        parts.append(f"c{k} AS MATERIALIZED (SELECT f.action_id, e.dst AS variable, f.delta * e.strength AS delta FROM f{k} f JOIN edges e ON e.src = f.variable)")
        seen = " UNION ALL ".join(f"SELECT action_id, variable FROM f{i}" for i in range(1, k + 1))
        if k < n:
            parts.append(f"f{k + 1} AS MATERIALIZED (SELECT action_id, variable, sum(delta) AS delta FROM c{k} WHERE (action_id, variable) NOT IN ({seen}) GROUP BY 1, 2)")
    every = " UNION ALL ".join(["SELECT * FROM d0"] + [f"SELECT * FROM c{k}" for k in range(1, n + 1)])
    return ", ".join(parts) + f", moved AS (SELECT action_id, variable, sum(delta) AS delta FROM ({every}) GROUP BY 1, 2)"


EFFECT = f"{DIRS}, edges AS ({EDGES}), {LINKACTS}, {DELTAS}, {rounds()}"
PREDICTED = """pred AS (SELECT m.action_id, s.entity_id, s.metric, s.value AS current, m.delta, round(greatest(0, s.value + m.delta), 4) AS predicted
  FROM moved m JOIN (SELECT *, entity_id || '_' || CASE metric WHEN 'utilization_pct' THEN 'utilization' WHEN 'latency_ms' THEN 'latency'
       WHEN 'packet_loss_pct' THEN 'packet_loss' WHEN 'throughput_gbps' THEN 'throughput' ELSE 'cpu' END AS variable FROM state) s USING (variable)
  WHERE abs(m.delta) >= 0.01)"""


def link_action_rows(spark, d):
    return cut(T.link_actions(spark, d))


query("propagate_deltas", sql("links nodes inc util scen", f"""WITH {EFFECT} SELECT action_id, variable, round(delta, 6) AS delta FROM moved"""))(
    lambda spark, d: propagate(graph(spark, d), W.initial_deltas(link_action_rows(spark, d), T.state(spark, d))).select(
        "action_id", "variable", F.round("delta", 6).alias("delta"))
)
query("counterfactual_state", sql("links nodes inc util state scen", f"""WITH {EFFECT}, {PREDICTED}
SELECT action_id, entity_id, metric, round(greatest(0, current + delta) + 1e-9, 6) AS predicted FROM pred"""))(
    lambda spark, d: exact_predictions(spark, d)
)


def exact_value(value, delta):
    """A predicted value; the small offset keeps decimal ties from rounding by their last binary digit."""
    return F.round(F.greatest(F.lit(0.0), value + delta) + 1e-9, 6)


def exact_predictions(spark, d):
    rows = W.counterfactual(link_action_rows(spark, d), cut(T.state(spark, d)), graph(spark, d))
    return rows.select("action_id", "entity_id", "metric", exact_value(F.col("current"), F.col("delta")).alias("predicted"))


def positive_value(value, delta):
    """As `exact_value`, and 0.0 for what only the offset keeps above it."""
    exact = exact_value(value, delta)
    return F.when(exact > 1e-8, exact).otherwise(0.0)


query("counterfactual_risk", sql("links nodes inc util state scen", f"""WITH {EFFECT}, {PREDICTED}
SELECT action_id, round(count(*) FILTER (delta > 0) / count(*), 4) AS causal_risk, count(DISTINCT entity_id) AS affected_entities FROM pred GROUP BY 1"""))(
    lambda spark, d: W.counterfactual_risk(W.effect(link_action_rows(spark, d), cut(T.state(spark, d)), graph(spark, d)))
)

APPLIED = """app AS (
SELECT action_id, entity_id, metric, value, CASE
    WHEN action_type = 'reroute' AND role = 'from' AND metric = 'utilization_pct' THEN greatest(0, value - value * 0.3::DOUBLE)
    WHEN action_type = 'reroute' AND role = 'from' AND metric = 'latency_ms' THEN value * 0.9::DOUBLE
    WHEN action_type = 'reroute' AND role = 'to' AND metric = 'utilization_pct' THEN least(100, value + util * 0.3::DOUBLE * 0.7::DOUBLE)
    WHEN action_type = 'rate_limit' AND metric = 'utilization_pct' THEN greatest(0, value * 0.8::DOUBLE)
    WHEN action_type = 'rate_limit' AND metric = 'packet_loss_pct' THEN greatest(0, value * 0.7::DOUBLE)
    WHEN action_type = 'scale_capacity' AND metric = 'utilization_pct' THEN value / 1.2::DOUBLE ELSE value END AS applied
FROM (SELECT action_id, action_type, util, link_id AS entity_id, 'from' AS role FROM wa WHERE action_type <> 'config_rollback'
      UNION ALL SELECT action_id, action_type, util, alternate, 'to' FROM wa WHERE action_type = 'reroute' AND alternate IS NOT NULL) r
JOIN state s USING (entity_id))"""
STEP = """CASE metric WHEN 'utilization_pct' THEN 50 + ({0} - 50) * pow(0.95::DOUBLE, k) WHEN 'latency_ms' THEN greatest(0.5::DOUBLE, 5 + ({0} - 5) * pow(0.97::DOUBLE, k)) ELSE {0} END"""
PROJECTED = f"proj AS (SELECT action_id, entity_id, metric, k, {STEP.format('applied')} AS projected FROM app, range(1, 6) r(k))"

query("project_state", sql("links inc util state scen", f"""WITH {LINKACTS}, {APPLIED}, {PROJECTED}
SELECT action_id, entity_id, metric, k::INT AS step, round(projected + 1e-9, 5) AS projected FROM proj"""))(
    lambda spark, d: W.project(W.apply_action(link_action_rows(spark, d), T.state(spark, d))).select(
        "action_id", "entity_id", "metric", "step", F.round(F.col("projected") + 1e-9, 5).alias("projected"))
)
query("projection_risk", sql("links inc util state scen", f"""WITH {LINKACTS}, {APPLIED},
every AS (SELECT w.action_id, s.entity_id, s.metric, CASE
    WHEN w.action_type = 'config_rollback' AND s.metric = 'utilization_pct' AND s.value > 70 THEN s.value * 0.8::DOUBLE
    WHEN w.action_type = 'config_rollback' AND s.metric = 'latency_ms' AND s.value > 20 THEN s.value * 0.85::DOUBLE
    ELSE coalesce(a.applied, s.value) END AS v
  FROM wa w JOIN state s ON true LEFT JOIN app a ON a.action_id = w.action_id AND a.entity_id = s.entity_id AND a.metric = s.metric),
steps AS (SELECT action_id, entity_id, k, max(p) FILTER (metric = 'utilization_pct') AS u, max(p) FILTER (metric = 'latency_ms') AS lt, max(p) FILTER (metric = 'packet_loss_pct') AS ls
  FROM (SELECT *, {STEP.format('v')} AS p FROM every, range(1, 6) r(k)) GROUP BY ALL),
worst AS (SELECT action_id, max(u) AS mu, max(lt) AS ml, max(ls) AS mp, count(*) FILTER (coalesce(ls, 0) > 1 OR coalesce(lt, 0) > 50) AS sla FROM steps GROUP BY 1)
SELECT action_id, round(mu, 4) AS max_utilization, mu < 85 AS projection_safe, sla AS sla_violations,
       round(0.4::DOUBLE * least(greatest((mu - 50) / 50, 0), 1) + 0.3::DOUBLE * least(greatest((ml - 10) / 90, 0), 1) + 0.2::DOUBLE * least(1, mp / 5) + 0.1::DOUBLE * least(1, sla / 10), 6) AS projection_risk
FROM worst"""))(
    lambda spark, d: W.projection_risk(link_action_rows(spark, d), cut(T.state(spark, d)))
)

# -- safety ------------------------------------------------------------------------------------------------------


def safety_input(spark, d):
    actions, state, network = link_action_rows(spark, d), cut(T.state(spark, d)), cut(T.links(spark, d))
    return S.SafetyInput(actions, state, W.effect(actions, state, graph(spark, d)), cut(T.nodes(spark, d)), network)


CHECKS = """cur AS (SELECT l.link_id, coalesce(u.value, 0)::DOUBLE AS current FROM links l LEFT JOIN util u USING (link_id)),
ahead AS (SELECT action_id, entity_id AS link_id, predicted FROM pred WHERE metric = 'utilization_pct'),
post AS (SELECT a.action_id, c.link_id, c.current, coalesce(p.predicted, c.current) AS p FROM (SELECT action_id FROM wa) a JOIN cur c ON true
  LEFT JOIN ahead p ON p.action_id = a.action_id AND p.link_id = c.link_id),
netw AS (SELECT action_id, count(*) FILTER (p > 85) AS over, count(*) FILTER (current < 80 AND p > 80) AS pushed, max(p) AS worst,
  max_by(link_id, {'p': p, 'l': link_id}) AS worst_link FROM post GROUP BY 1),
touch AS (SELECT action_id, source AS node_id FROM wa UNION SELECT action_id, target FROM wa UNION SELECT action_id, entity_id FROM pred),
cust AS (SELECT action_id, sum(customers) AS c FROM touch JOIN nodes USING (node_id) GROUP BY 1),
paths AS (SELECT link_id, count(*) AS k FROM links GROUP BY 1)"""
VERDICT = """verdict AS (SELECT w.action_id, w.action_type, n.over > 0 AS v1, n.pushed > 0 AS v2,
  coalesce(c.c, 0) > 0.05 * (SELECT sum(customers) FROM nodes) AS v3,
  CASE w.action_type WHEN 'reroute' THEN w.capacity_gbps * coalesce(h.predicted, w.util) / 100 * 0.3 WHEN 'rate_limit' THEN w.capacity_gbps * 0.2 ELSE 0 END
    > 0.2 * (SELECT sum(capacity_gbps) FROM links) AS v5,
  w.action_type NOT IN ('reroute', 'rate_limit') AS v6
  FROM wa w JOIN netw n USING (action_id) LEFT JOIN cust c USING (action_id) LEFT JOIN ahead h ON h.action_id = w.action_id AND h.link_id = w.link_id)"""

# Every link with a reading ends in a user node that has no other link, so one path joins its ends.
query("constraint_verdicts", sql("links nodes inc util state scen", f"""WITH {EFFECT}, {PREDICTED}, {CHECKS}, {VERDICT}
SELECT action_id, NOT (v1 OR v2 OR v3 OR v5 OR v6) AS is_safe, concat_ws(',', CASE WHEN v1 THEN 'max_link_utilization' END, CASE WHEN v2 THEN 'no_cascading_overload' END,
  CASE WHEN v3 THEN 'customer_isolation' END, CASE WHEN v5 THEN 'blast_radius_cap' END, CASE WHEN v6 THEN 'rollback_path_exists' END) AS violations FROM verdict"""))(
    lambda spark, d: S.verify(safety_input(spark, d)).select("action_id", "is_safe", F.array_join("violations", ",").alias("violations"))
)
query("worst_link_after", sql("links nodes inc util state scen", f"""WITH {EFFECT}, {PREDICTED}, {CHECKS}
SELECT action_id, round(worst, 3) AS worst_util FROM netw"""))(
    lambda spark, d: S.worst_link(safety_input(spark, d)).select("action_id", F.round("worst_util", 3).alias("worst_util"))
)


def rule_verdicts(actions, links, rules, history=None):
    given = S.SafetyInput(actions, None, None, None, links, history)
    return S.verify(given, rules).select("action_id", "is_safe", F.array_join("violations", ",").alias("violations"))


@query("rate_limit_verdicts", sql("utel", """
SELECT 'E' || e.seq AS action_id, count(p.ts) < 3 AS is_safe, CASE WHEN count(p.ts) < 3 THEN '' ELSE 'rate_limit_cap' END AS violations
FROM (SELECT * FROM utel WHERE metric = 'packet_loss_pct') e LEFT JOIN (SELECT ts FROM utel WHERE metric <> 'packet_loss_pct') p
ON p.ts <= e.ts AND p.ts >= e.ts - INTERVAL 10 MINUTE GROUP BY e.seq"""))
def rate_limit_verdicts(spark, d):
    """An action at every error, with all other events as the actions executed before it."""
    rows = T.user_telemetry(spark, d)
    actions = rows.where("metric = 'packet_loss_pct'").select(
        F.concat(F.lit("E"), "seq").alias("action_id"), "ts", F.lit("rate_limit").alias("action_type"), F.lit(None).cast("string").alias("target_link"),
        F.col("entity_id").alias("target_node"), F.lit(None).cast("map<string,string>").alias("parameters"))
    return rule_verdicts(actions, None, {"rate_limit_cap": S.rate_limit_cap}, rows.where("metric <> 'packet_loss_pct'").select("ts"))


@query("rollback_verdicts", sql("links", """
WITH arcs AS (SELECT link_id, source AS a, target AS b FROM links UNION ALL SELECT link_id, target, source FROM links),
walk AS (SELECT link_id, source AS node, target, 0 AS hop FROM links
  UNION SELECT w.link_id, a.b, w.target, w.hop + 1 FROM walk w JOIN arcs a ON a.a = w.node AND a.link_id <> w.link_id WHERE w.hop < 6 AND w.node <> w.target)
SELECT 'R/' || link_id AS action_id, bool_or(node = target) AS is_safe, CASE WHEN bool_or(node = target) THEN '' ELSE 'rollback_path_exists' END AS violations FROM walk GROUP BY 1""", recursive=True))
def rollback_verdicts(spark, d):
    """Taking each link of the network away: safe where its ends stay joined within six hops."""
    links = cut(T.links(spark, d))
    actions = links.select(
        F.concat(F.lit("R/"), "link_id").alias("action_id"), F.lit("config_rollback").alias("action_type"), F.col("link_id").alias("target_link"),
        F.lit(None).cast("string").alias("target_node"), F.lit(None).cast("map<string,string>").alias("parameters"))
    return rule_verdicts(actions, links, {"rollback_path_exists": S.rollback_path_exists})


@query("verdict_proofs")
def verdict_proofs(spark, d):
    return S.explain(S.verify(safety_input(spark, d)))


query("state_overlay", sql("links nodes inc util state scen", f"""WITH {EFFECT}, {PREDICTED}
SELECT action_id, entity_id, metric, CASE WHEN current + delta <= 0 THEN current ELSE round(current + delta + 1e-9, 6) END AS value FROM pred"""))(
    lambda spark, d: S.merge_states(
        T.state(spark, d), W.effect(link_action_rows(spark, d), cut(T.state(spark, d)), graph(spark, d), predict=positive_value), True)
)
query("rolling_action_count", sql("utel", """
SELECT 'E' || e.seq AS action_id, count(p.ts) AS recent FROM (SELECT * FROM utel WHERE metric = 'packet_loss_pct') e
LEFT JOIN (SELECT ts FROM utel WHERE metric = 'throughput_gbps') p ON p.ts <= e.ts AND p.ts >= e.ts - INTERVAL 600 MINUTE GROUP BY 1"""))(
    lambda spark, d: S.recent_actions(
        T.user_telemetry(spark, d).where("metric = 'packet_loss_pct'").select(F.concat(F.lit("E"), "seq").alias("action_id"), "ts"),
        T.user_telemetry(spark, d).where("metric = 'throughput_gbps'").select("ts"), 600)
)


@query("ranked_decisions")
def ranked_decisions(spark, d):
    """Hypotheses to verified, ranked actions in one job."""
    rows = decide(T.hypotheses(spark, d), cut(T.state(spark, d)), cut(T.nodes(spark, d)), cut(T.links(spark, d)), graph(spark, d))
    return rows.select("incident_id", "action_id", "rank", "rank_parity", "is_safe", "utility_score", F.round("risk_level", 5).alias("risk_level"),
                       "decided_type", "requires_approval", "needs_review", F.array_join("violations", ",").alias("violations"))


# -- outcomes ----------------------------------------------------------------------------------------------------


def outcome_rows(spark, d):
    return O.label_outcomes(T.results(spark, d), "action_id", "ts", "action_type", "scenario_type")


query("outcome_label", sql("outc", "SELECT action_id, action_type, scenario_type, improved::BIGINT AS improved, harmful, outcome FROM outc"))(
    lambda spark, d: outcome_rows(spark, d).select("action_id", "action_type", "scenario_type", "improved", "harmful", "outcome")
)
RATES = """SELECT scenario_type, action_type, count(*) AS total, count(*) FILTER (outcome IN ('effective', 'partially_effective')) AS successes,
round(count(*) FILTER (outcome IN ('effective', 'partially_effective')) / count(*), 6) AS rate FROM outc GROUP BY GROUPING SETS ((scenario_type, action_type), (action_type))"""
query("success_rate", sql("outc", RATES))(
    lambda spark, d: O.success_rates(outcome_rows(spark, d)).select("scenario_type", "action_type", "total", "successes", F.round("rate", 6).alias("rate"))
)
query("success_rate_lookup", sql("outc", f"""
WITH want AS (SELECT DISTINCT scenario_type, action_type FROM outc UNION ALL SELECT NULL, 'reroute' UNION ALL SELECT NULL, 'scale_capacity'), rates AS ({RATES})
SELECT w.scenario_type, w.action_type, coalesce(r.rate, 0.5)::DOUBLE AS rate FROM want w LEFT JOIN rates r
ON r.action_type IS NOT DISTINCT FROM w.action_type AND r.scenario_type IS NOT DISTINCT FROM w.scenario_type"""))(
    lambda spark, d: O.success_rate(
        O.success_rates(outcome_rows(spark, d)),
        outcome_rows(spark, d).select("scenario_type", "action_type").distinct().unionByName(
            spark.createDataFrame([(None, "reroute"), (None, "scale_capacity")], "scenario_type string, action_type string")),
    ).withColumn("rate", F.round("rate", 6))
)
query("outcome_metrics", sql("outc", """
SELECT count(*) AS total_actions, count(*) FILTER (outcome = 'effective') AS effective, count(*) FILTER (outcome = 'partially_effective') AS partially_effective,
       count(*) FILTER (outcome = 'ineffective') AS ineffective, count(*) FILTER (outcome = 'harmful') AS harmful,
       round(count(*) FILTER (outcome IN ('effective', 'partially_effective')) / count(*), 6) AS success_rate,
       round(count(*) FILTER (outcome IN ('ineffective', 'harmful')) / count(*), 6) AS false_positive_rate FROM outc"""))(
    lambda spark, d: O.outcome_metrics(outcome_rows(spark, d)).withColumns(
        {"success_rate": F.round("success_rate", 6), "false_positive_rate": F.round("false_positive_rate", 6)})
)
query("recommendations", sql("outc act", """
SELECT 'Recommend raising anomaly detection thresholds' AS recommendation FROM outc HAVING count(*) FILTER (outcome IN ('ineffective', 'harmful')) / count(*) > 0.3
UNION ALL SELECT 'Recommend deprioritizing ' || action_type || ' for ' || scenario_type FROM outc GROUP BY action_type, scenario_type
  HAVING count(*) >= 3 AND count(*) FILTER (outcome IN ('ineffective', 'harmful')) / count(*) >= 0.6
UNION ALL SELECT 'Recommend lowering confidence thresholds for auto-execution' FROM act HAVING avg(post_latency * 10) > 600"""))(
    lambda spark, d: O.recommendations(outcome_rows(spark, d), T.action_log(spark, d).select((F.col("post_latency") * 10).alias("seconds")))
)
query("harmful_notices", sql("outc", """
SELECT action_id, 'Harmful outcome detected for action_type=' || action_type || ' scenario=' || scenario_type || '. Recommend lowering future utility weighting.' AS notice
FROM outc WHERE outcome = 'harmful'"""))(lambda spark, d: O.harmful_notices(outcome_rows(spark, d)))

WATCHED = "SELECT 'W' || seq AS action_id, ts, entity_id, metric, value AS pre FROM tel WHERE metric IN ('throughput_gbps', 'utilization_pct')"
query("auto_rollback", sql("tel", f"""
SELECT a.action_id, epoch_us(min(t.ts)) AS breach_us, count(*) AS breaches FROM ({WATCHED}) a
JOIN tel t ON t.entity_id = a.entity_id AND t.metric = a.metric AND t.ts > a.ts AND t.ts <= a.ts + INTERVAL 4320 MINUTE
WHERE a.pre > 0 AND CASE a.metric WHEN 'throughput_gbps' THEN t.value < a.pre * 0.8::DOUBLE ELSE t.value > a.pre * 1.2::DOUBLE END GROUP BY 1"""))(
    lambda spark, d: O.rollback_breaches(
        T.telemetry(spark, d).where("metric IN ('throughput_gbps', 'utilization_pct')").select(
            F.concat(F.lit("W"), "seq").alias("action_id"), "ts", "entity_id", "metric", F.col("value").alias("pre")),
        T.telemetry(spark, d), 4320).select("action_id", F.unix_micros("breach_ts").alias("breach_us"), "breaches")
)
query("rollback_choice", sql("act", """
SELECT region, b.a AS action_id, epoch_us(b.ts) AS ts_us FROM (
  SELECT r_name AS region, max_by({'a': a.action_id, 'ts': a.ts}, {'t': a.ts, 'a': a.action_id}) AS b
  FROM act a JOIN orders o ON o.o_orderkey = a.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE o_orderstatus = 'F' AND a.action_type NOT IN ('create_ticket', 'escalate') GROUP BY 1)"""))(
    lambda spark, d: O.rollback_choice(results_with_region(spark, d), "region").select("region", "action_id", micros())
)


def results_with_region(spark, d):
    nation, region = T.table(spark, d, "nation"), T.table(spark, d, "region")
    at = T.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    orders = T.table(spark, d, "orders").select(F.concat(F.lit("A"), "o_orderkey").alias("action_id"), "o_orderstatus")
    rows = T.action_log(spark, d).join(orders, "action_id").join(at.select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("region")), "o_custkey")
    return rows.withColumns({"success": F.col("o_orderstatus") == "F", "rollback_token": F.concat(F.lit("T"), "action_id")})


query("outcome_features", sql("act outc", """
SELECT o.action_id, a.pre_latency AS pre_link_latency_ms, a.pre_util AS pre_link_utilization_pct, a.pre_loss AS pre_link_packet_loss_pct,
       o.scenario_type AS anomaly_type, o.action_type, o.outcome FROM outc o JOIN act a USING (action_id)"""))(
    lambda spark, d: outcome_feature_rows(spark, d)
)


def outcome_feature_rows(spark, d):
    from tickwarden.operators.reshape import outcome_features

    pre = T.results(spark, d).groupBy("action_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "pre"))).alias("pre_metrics"))
    rows = outcome_rows(spark, d).join(pre, "action_id").withColumn("confidence", F.lit(0.5))
    rows = rows.withColumn("_id", F.col("action_id"))
    names = ["link.latency_ms", "link.utilization_pct", "link.packet_loss_pct"]
    featured = outcome_features(rows.withColumn("outcome", F.struct("_id", "outcome")), names)
    return featured.select(F.col("outcome._id").alias("action_id"), "pre_link_latency_ms", "pre_link_utilization_pct", "pre_link_packet_loss_pct",
                           "anomaly_type", "action_type", F.col("outcome.outcome").alias("outcome"))


query("detection_samples", sql("ens", """
SELECT entity_id, metric, observed AS observed_value, expected AS expected_value, 1 AS label, severity AS scenario_type FROM ens"""))(
    lambda spark, d: O.detection_samples(ensemble_rows(spark, d), F.col("severity"))
)
query("retrain_signals", sql("ens", """
SELECT day, n, samples::BIGINT AS samples FROM (SELECT day, n, sum(n) OVER (ORDER BY day) AS samples FROM (SELECT epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM ens GROUP BY 1))
WHERE samples // 100 > (samples - n) // 100"""))(
    lambda spark, d: O.retrain_signals(ensemble_rows(spark, d).groupBy(day().alias("day")).agg(F.count("*").alias("n")), "day", "n")
)
query("reroute_suggestion", sql("tel", """
SELECT day, CASE WHEN v >= 80 THEN 'reroute' ELSE 'no_action' END AS action_type, CASE WHEN v >= 80 THEN worst END AS target_link,
       CASE WHEN v >= 80 THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence, round(v, 4) AS worst_util FROM (
  SELECT epoch_us(ts) // 86400000000 AS day, max_by(entity_id, {'v': value, 'e': entity_id}) AS worst, max(value) AS v FROM tel WHERE metric = 'utilization_pct' GROUP BY 1)"""))(
    lambda spark, d: W.suggest_reroute(T.telemetry(spark, d).withColumn("day", day()), "day")
)
query("penalty_score", sql("tel", """
SELECT day, round(-(0.4 * u + 0.3 * l + 0.2 * p + 0.1 * s), 5)::DOUBLE AS reward FROM (
  SELECT epoch_us(ts) // 86400000000 AS day, coalesce(sum((value - 80) / 20) FILTER (metric = 'utilization_pct' AND value > 80), 0)::DOUBLE AS u,
         coalesce(sum((value - 30) / 20) FILTER (metric = 'latency_ms' AND value > 30), 0)::DOUBLE AS l,
         coalesce(sum(value) FILTER (metric = 'packet_loss_pct' AND value > 0.5), 0)::DOUBLE AS p, count(*) FILTER (metric = 'packet_loss_pct' AND value > 0.5) AS s FROM tel GROUP BY 1)"""))(
    lambda spark, d: W.penalty_score(T.telemetry(spark, d).withColumn("day", day()), "day").withColumn("reward", F.round("reward", 5))
)
query("run_counters", sql("ens outc", """
SELECT count(*) FILTER (kind = 'anomaly') AS anomalies, count(*) FILTER (kind = 'action' AND ok) AS actions_ok, count(*) FILTER (kind = 'action' AND NOT ok) AS actions_failed
FROM (SELECT 'anomaly' AS kind, NULL::BOOLEAN AS ok FROM ens UNION ALL SELECT 'action', outcome <> 'harmful' FROM outc)"""))(
    lambda spark, d: counters(spark, d)
)


def counters(spark, d):
    from tickwarden.streaming.processors import run_counters

    rows = ensemble_rows(spark, d).select(F.lit("anomaly").alias("kind"), F.lit(None).cast("boolean").alias("ok")).unionByName(
        outcome_rows(spark, d).select(F.lit("action").alias("kind"), (F.col("outcome") != "harmful").alias("ok")))
    return run_counters(rows)


query("opinion_summary", sql("", """
WITH o AS (SELECT conv_id, turn, list_extract(['reliability', 'performance', 'cost_sla'], turn % 3 + 1) || ':' ||
    CASE role WHEN 'user' THEN 'support' WHEN 'assistant' THEN 'oppose' ELSE 'conditional' END AS stance FROM conversations)
SELECT conv_id::VARCHAR AS action_id, printf('Decided: modify, agreement %.2f. Voices: %s. Because: %s', 0.5::DOUBLE, array_to_string(list(stance ORDER BY turn), ', '), 'canary first') AS summary
FROM o GROUP BY 1"""))(
    lambda spark, d: opinions(spark, d).select("action_id", "summary")
)


def opinions(spark, d):
    said = T.opinions(spark, d)
    decided = said.select("action_id").distinct().select(
        "action_id", F.lit("modify").alias("final_decision"), F.lit(0.5).alias("consensus_score"), F.lit("canary first").alias("rationale"))
    return O.opinion_summary(said, decided)


@query("opinion_transcripts", sql("", """
WITH o AS (SELECT conv_id, turn, printf('[%s] %s, %.2f sure', list_extract(['reliability', 'performance', 'cost sla'], turn % 3 + 1),
    CASE role WHEN 'user' THEN 'support' WHEN 'assistant' THEN 'oppose' ELSE 'conditional' END, (length(text) % 100 / 100.0)::DOUBLE) || coalesce(chr(10) || text, '') AS part
  FROM conversations)
SELECT conv_id::VARCHAR AS action_id, array_to_string(list(part ORDER BY turn), chr(10) || chr(10)) || chr(10) || chr(10) || '[decision] modify, agreement 0.50' || chr(10) || 'canary first' AS transcript
FROM o GROUP BY 1"""))
def opinion_transcripts(spark, d):
    return opinions(spark, d).select("action_id", "transcript")


# -- examples ----------------------------------------------------------------------------------------------------


def example_rows(spark, d):
    pre = T.results(spark, d).groupBy("action_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.round(F.col("pre") + 1e-9, 3).alias("pre"))))).alias("pre_metrics"))
    rows = outcome_rows(spark, d).join(pre, "action_id")
    return rows.select("*", F.concat_ws("_", "action_id", F.lit("utilization")).alias("root_cause"),
                       F.concat_ws(" ", F.lit("Change after"), "action_type").alias("description"), F.lit(0.75).alias("confidence"))


query("sft_messages", sql("act outc", """
SELECT 'Incident type: ' || o.scenario_type || chr(10) || 'Seen: Change after ' || o.action_type || chr(10) || 'Suspected origin: ' || o.action_id || '_utilization (0.75 sure)' || chr(10)
  || 'Metrics before any action:' || chr(10) || printf('  link.latency_ms: %.3f', round(pre_latency + 1e-9, 3)) || chr(10) || printf('  link.packet_loss_pct: %.3f', round(pre_loss + 1e-9, 3)) || chr(10)
  || printf('  link.utilization_pct: %.3f', round(pre_util + 1e-9, 3)) || chr(10) || chr(10) || 'Which action do you propose?' AS user_text,
  'Proposal: ' || o.action_type || chr(10) || 'Reason: ' || o.scenario_type || ' starting at ' || o.action_id || '_utilization is met with ' || o.action_type || ', 0.75 sure.' || chr(10)
  || CASE outcome WHEN 'effective' THEN 'Afterwards the readings were back to normal.' WHEN 'partially_effective' THEN 'Afterwards some readings were better, others were not.'
     WHEN 'ineffective' THEN 'Afterwards nothing had improved; try something else.' ELSE 'Afterwards things were worse; do not repeat this here.' END AS assistant_text, outcome
FROM outc o JOIN act a USING (action_id)"""))(
    lambda spark, d: DS.conversations(example_rows(spark, d)).select(
        F.col("messages")[1]["content"].alias("user_text"), F.col("messages")[2]["content"].alias("assistant_text"), F.col("metadata")["outcome"].alias("outcome"))
)

"""Candidate actions, their predicted effect, utility and policy. One row per action, any number of incidents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwarden.functions.ids import endpoint, full_metric, lookup, root_target, split_variable
from tickwarden.functions.severity import clamp
from tickwarden.functions.text import decision_class, joined, text_severity
from tickwarden.operators.causal import CausalGraph, spread
from tickwarden.operators.series import best_rows
from tickwarden.operators.topology import alternate_link, pairs_at
from tickwarden.schemas import PASSIVE_ACTIONS
from tickwarden.session import cut

# Decision tables.
PENALTY = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.1}
COST = {
    "reroute": 0.3, "rate_limit": 0.2, "config_rollback": 0.4,
    "escalate": 0.1, "create_ticket": 0.05, "scale_capacity": 0.5,
}
OPERATIONAL_RISK = {
    "reroute": 0.4, "rate_limit": 0.2, "config_rollback": 0.5,
    "escalate": 0.0, "create_ticket": 0.0, "scale_capacity": 0.3,
}
BASE_RISK = {
    "reroute": 0.55, "rate_limit": 0.35, "config_rollback": 0.6,
    "escalate": 0.15, "create_ticket": 0.05, "scale_capacity": 0.5,
}
EFFECTIVENESS = {
    "reroute": 0.7, "rate_limit": 0.68, "config_rollback": 0.72,
    "escalate": 0.45, "create_ticket": 0.25, "scale_capacity": 0.75,
}
CLASS_ACTIONS = {
    "congestion": ("reroute", "rate_limit"),
    "hardware": ("escalate", "create_ticket"),
    "ddos": ("rate_limit", "escalate"),
    "misconfiguration": ("config_rollback", "create_ticket"),
    "link_down": ("reroute", "escalate"),
}
LINK_ACTIONS = ("reroute", "rate_limit", "scale_capacity")
TRAFFIC_FRACTION, REDUCTION_PCT, NEW_WEIGHT, LIMIT_PCT = 0.3, 20.0, 8.0, 70.0
SAFE_UTILIZATION = 85.0


def _texts(value) -> Column:
    return value.cast("string")


def expected_impact(kind: Column, target: Column) -> Column:
    """Sentence for operators."""
    at = F.coalesce(target, F.lit("network segment"))
    return (
        F.when(kind == "reroute", F.format_string("Shift traffic away from %s to relieve congestion and latency.", at))
        .when(kind == "rate_limit", F.format_string("Throttle suspicious or excessive flow on %s to protect stability.", at))
        .when(kind == "scale_capacity", F.format_string("Increase available throughput on %s to absorb burst demand.", at))
        .when(kind == "config_rollback", F.format_string("Revert recent config changes affecting %s.", at))
        .when(kind == "escalate", F.format_string("Escalate incident impacting %s to on-call experts.", at))
        .otherwise(F.format_string("Create operator ticket for manual investigation on %s.", at))
    )


def parameters(kind: Column, link: Column, alternate: Column, capacity: Column, description: Column) -> Column:
    """Parameter map per action type; entries without a value are left out."""
    def entries(**values):
        pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
    return (
        F.when(kind == "reroute", entries(
            from_link=link, to_link=alternate, traffic_fraction=F.lit(TRAFFIC_FRACTION),
            source_node=endpoint(link, 0), target_node=endpoint(link, 1), new_weight=F.lit(NEW_WEIGHT)))
        .when(kind == "rate_limit", entries(
            target_link=link, limit_pct=F.lit(LIMIT_PCT), reduction_pct=F.lit(REDUCTION_PCT)))
        .when(kind == "scale_capacity", entries(target_link=link, new_capacity_gbps=F.round(capacity * 1.2, 4)))
        .when(kind == "config_rollback", entries(rollback_token=F.lit("latest")))
        .when(kind == "escalate", entries(priority=F.lit("high"), team=F.lit("netops")))
        .when(kind == "create_ticket", entries(queue=F.lit("noc"), summary=description))
    )


def candidates(hypotheses: DataFrame, links: DataFrame, whole_words: bool = False) -> DataFrame:
    """One row per (hypothesis, action type its class suggests). `hypotheses` carry `hypothesis_id`."""
    text = joined(
        F.col("description"), F.col("root_cause"), F.array_join("evidence", " "), F.array_join("recommended_actions", " ")
    )
    severity = text_severity(joined(F.col("description"), F.array_join("evidence", " ")))
    node, link = root_target(F.col("root_cause"), F.col("affected_links"), F.col("affected_nodes"))
    table = {k: ",".join(v) for k, v in CLASS_ACTIONS.items()}
    rows = hypotheses.select(
        "*", decision_class(text, whole_words).alias("hypothesis_class"), severity.alias("text_severity"),
        node.alias("_node"), link.alias("_link"),
    )
    rows = rows.withColumn(
        "action_type", F.explode(F.split(lookup(table, F.col("hypothesis_class"), "create_ticket,escalate"), ","))
    )
    on_link = F.col("action_type").isin(*LINK_ACTIONS)
    first_link = F.try_element_at("affected_links", F.lit(1))
    risk = (
        lookup(BASE_RISK, F.col("action_type"), 0.4)
        + (1.0 - F.col("confidence")) * 0.2
        + lookup(PENALTY, F.col("text_severity")) * 0.25
    )
    rows = rows.withColumns({
        "action_id": F.concat_ws("/", "hypothesis_id", "action_type"),
        "work_link": F.coalesce("_link", first_link),
        "target_link": F.when(on_link, F.coalesce("_link", first_link)),
        "target_node": F.when(~on_link, F.col("_node")),
        "risk_level": F.least(F.lit(1.0), risk),
        "expected_impact": expected_impact(F.col("action_type"), F.coalesce("_link", "_node")),
    })
    facts = links.select(F.col("link_id").alias("work_link"), F.col("capacity_gbps").alias("_cap"))
    other = alternate_link(links).withColumnsRenamed({"link_id": "work_link", "alternate": "_alt"})
    rows = rows.join(facts, "work_link", "left").join(other, "work_link", "left")
    return rows.withColumn(
        "parameters",
        parameters(F.col("action_type"), F.col("work_link"), F.col("_alt"), F.coalesce("_cap", F.lit(100.0)), F.col("description")),
    ).drop("_node", "_link", "_cap", "_alt", "work_link")


def affected_entities(hypotheses: DataFrame, key: str = "hypothesis_id") -> DataFrame:
    return hypotheses.select(key, F.explode(F.concat("affected_nodes", "affected_links")).alias("entity_id"))


def utility(actions: DataFrame, impact: DataFrame, key: str = "hypothesis_id") -> DataFrame:
    """Add `utility_score`: -impact x penalty - cost x operational risk + chance of fixing x penalty."""
    kind, penalty = F.col("action_type"), lookup(PENALTY, F.col("text_severity"))
    score = (
        -(F.coalesce("impact", F.lit(0.0)) * penalty)
        - lookup(COST, kind) * lookup(OPERATIONAL_RISK, kind)
        + F.col("confidence") * lookup(EFFECTIVENESS, kind, 0.7) * penalty
    )
    return actions.join(impact.select(key, "impact"), key, "left").withColumn("utility_score", F.round(score, 6)).drop("impact")


def action_link(kind: Column, params: Column, target_link: Column) -> tuple[Column, Column]:
    """(link an action works on, link traffic moves to)."""
    get = lambda name: F.try_element_at(params, F.lit(name))
    source = F.when(kind == "reroute", F.coalesce(get("from_link"), target_link)).when(
        kind.isin("rate_limit", "scale_capacity"), F.coalesce(get("target_link"), target_link)
    )
    return source, F.when(kind == "reroute", get("to_link"))


def initial_deltas(actions: DataFrame, state: DataFrame) -> DataFrame:
    """Utilisation deltas of reroute and rate-limit actions: action_id, variable, delta."""
    kind = F.col("action_type")
    source, target = action_link(kind, F.col("parameters"), F.col("target_link"))
    number = lambda name, default: F.coalesce(
        F.try_element_at("parameters", F.lit(name)).try_cast("double"), F.lit(default)
    )
    util = state.where(F.col("metric") == "utilization_pct").select(F.col("entity_id").alias("from_link"), F.col("value").alias("util"))
    rows = actions.where(kind.isin("reroute", "rate_limit")).select(
        "action_id", "action_type", source.alias("from_link"), target.alias("to_link"),
        number("traffic_fraction", TRAFFIC_FRACTION).alias("fraction"), number("reduction_pct", REDUCTION_PCT).alias("reduction"),
    ).join(util, "from_link", "left").withColumn("util", F.coalesce("util", F.lit(0.0)))
    moved = F.when(F.col("action_type") == "reroute", F.col("util") * F.col("fraction")).otherwise(
        F.least("reduction", "util")
    )
    entry = lambda link, delta: F.struct(F.col(link).alias("entity_id"), delta.alias("delta"))
    rows = rows.select("action_id", F.inline(F.array(entry("from_link", -moved), entry("to_link", moved))))
    rows = rows.where(F.col("entity_id").isNotNull())
    return rows.select("action_id", F.concat("entity_id", F.lit("_utilization")).alias("variable"), "delta")


@dataclass
class Effect:
    """Predicted values, where readings that an action moves alike are not told apart.

    `rows`: action_id, entity_id, metric, current, delta, predicted. `groups`: action_id, hub, group, metric, delta, apart: the
    action moves every reading in `members` (hub, group, leaf, entity_id, metric, value) by that, but those of the leaves
    `apart`, which `rows` has. An entity has readings of one leaf only. Without groups `rows` has everything. `predict` gives
    the predicted value of a current one and its delta.
    """

    rows: DataFrame
    groups: DataFrame | None = None
    members: DataFrame | None = None
    predict: Callable[[Column, Column], Column] | None = None

    def beside(self, facts: DataFrame) -> Effect:
        """The same with the columns of `facts` (entity_id, metric, ...) beside each reading, null where it has none.

        They are joined to the readings before these are repeated per action.
        """
        join = lambda rows: None if rows is None else rows.join(facts, ["entity_id", "metric"], "left")
        return replace(self, rows=join(self.rows), members=join(self.members))

    def told_apart(self) -> DataFrame:
        """The readings that `groups` leaves out: action_id, hub, group, entity_id, metric, value, delta."""
        rows = self.groups.select("action_id", "hub", "group", "metric", "delta", F.explode("apart").alias("leaf"))
        return rows.join(self.members, ["hub", "group", "leaf", "metric"]).drop("leaf")

    def all_rows(self) -> DataFrame:
        """One row per (action, reading), as many as the answer has. Those of groups are written without a shuffle of them."""
        if self.groups is None:
            return self.rows
        told = pairs_at(self.groups.drop("hub"), self.members.drop("metric", "hub"), "group").where(~F.array_contains("apart", F.col("leaf")))
        return self.rows.unionByName(_ahead(told.withColumnRenamed("value", "current"), self.predict).select(self.rows.columns))

    def total(self, weights: DataFrame | None = None, also: DataFrame | None = None, name: str = "n") -> DataFrame:
        """(action_id, `name`): weight of the distinct entities an action touches, by default their number.

        `weights`: entity_id, w. `also`: action_id, entity_id, touched besides the predicted ones.
        """
        own = self.rows.select("action_id", "entity_id")
        own = (own if also is None else own.unionByName(also)).distinct()
        weigh = lambda rows: rows.withColumn("w", F.lit(1)) if weights is None else rows.join(weights, "entity_id")
        parts = weigh(own).select("action_id", "w")
        if self.groups is not None:
            # Entities of one hub that stand in the same groups are counted together; one that is touched otherwise is not.
            spans = cut(self.members.groupBy("hub", "entity_id").agg(F.array_sort(F.collect_set("group")).alias("_in")))
            alike = weigh(spans).groupBy("hub", "_in").agg(F.sum("w").alias("w"))
            active = cut(self.groups.groupBy("action_id", "hub").agg(F.collect_set("group").alias("_active")))
            hit = active.join(alike, "hub").where(F.arrays_overlap("_in", "_active"))
            twice = own.unionByName(self.told_apart().select("action_id", "entity_id")).distinct().join(spans, "entity_id")
            twice = weigh(twice.join(active, ["action_id", "hub"]).where(F.arrays_overlap("_in", "_active")))
            parts = parts.unionByName(hit.select("action_id", "w")).unionByName(twice.select("action_id", (-F.col("w")).alias("w")))
        return parts.groupBy("action_id").agg(F.sum("w").alias(name))


def _ahead(rows: DataFrame, predict: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    return rows.withColumn("predicted", (predict or predicted_value)(F.col("current"), F.col("delta")))


def predicted_value(value: Column, delta: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), value + delta), 4)


def effect(
    actions: DataFrame, state: DataFrame, graph: CausalGraph, compat: bool = False, predict: Callable[[Column, Column], Column] | None = None
) -> Effect:
    """Predicted values for metrics the state tracks, as far as actions tell them apart.

    `compat` cuts variable names at the last underscore, which loses the two-word metrics. `predict` is `predicted_value` by default.
    """
    entity, short = split_variable(F.col("variable"), compat)
    read = lambda rows, *more: rows.select(*more, entity.alias("entity_id"), full_metric(short).alias("metric")).join(
        state.select("entity_id", "metric", "value"), ["entity_id", "metric"])
    told = spread(graph, initial_deltas(actions, state))
    big = F.abs("delta") >= 0.01
    rows = read(told.rows.where(big), "action_id", "delta").withColumnRenamed("value", "current")
    rows = _ahead(rows, predict).select("action_id", "entity_id", "metric", "current", "delta", "predicted")
    if told.alike is None:
        return Effect(rows, predict=predict)
    members = read(told.cones, "hub", "leaf", "depth", "weights")
    members = cut(members.withColumn("group", F.to_json(F.struct("hub", "depth", "weights", "metric"))))
    kinds = members.select("hub", "depth", "weights", "group", "metric").distinct()
    groups = told.moved(kinds).where(big).select("action_id", "hub", "group", "metric", "delta", "apart")
    return Effect(cut(rows), cut(groups), members.select("hub", "group", "leaf", "entity_id", "metric", "value"), predict)


def counterfactual(actions: DataFrame, state: DataFrame, graph: CausalGraph, compat: bool = False) -> DataFrame:
    """Predicted values per (action, entity, metric) for metrics the state tracks: every row of `effect`."""
    return effect(actions, state, graph, compat).all_rows()


def counterfactual_risk(predicted: DataFrame | Effect) -> DataFrame:
    """Share of predicted metrics that rise, and how many entities are touched."""
    given = predicted if isinstance(predicted, Effect) else Effect(predicted)
    parts = given.rows.select("action_id", "delta", F.lit(1).alias("n"))
    if given.groups is not None:
        sizes = given.members.groupBy("group").agg(F.count("*").alias("n"))
        parts = parts.unionByName(given.groups.join(sizes, "group").select("action_id", "delta", "n"))
        parts = parts.unionByName(given.told_apart().select("action_id", "delta", F.lit(-1).alias("n")))
    share = parts.groupBy("action_id").agg(
        F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("n"))), F.lit(0)).alias("_up"), F.sum("n").alias("_n"))
    return share.where("_n > 0").join(given.total(name="affected_entities"), "action_id").select(
        "action_id", F.round(F.col("_up") / F.col("_n"), 4).alias("causal_risk"), "affected_entities")


def relevant_state(actions: DataFrame, state: DataFrame) -> DataFrame:
    """State rows an action changes: its own links, with their role. A rollback changes every congested row."""
    source, target = action_link(F.col("action_type"), F.col("parameters"), F.col("target_link"))
    roles = actions.select(
        "action_id", "action_type", "parameters",
        F.inline(F.array(
            F.struct(source.alias("entity_id"), F.lit("from").alias("role")),
            F.struct(target.alias("entity_id"), F.lit("to").alias("role")),
        )),
        source.alias("source_link"),
    ).where(F.col("entity_id").isNotNull())
    return roles.join(state.select("entity_id", "metric", "value"), "entity_id")


def applied_value(kind: Column, role: Column, metric: Column, value: Column, source_util: Column, fraction: Column, reduction: Column) -> Column:
    """Value of one metric right after the action, from the values before it."""
    util, late, loss = metric == "utilization_pct", metric == "latency_ms", metric == "packet_loss_pct"
    limited = F.greatest(F.lit(0.0), value * (1.0 - reduction / 100.0))
    return (
        F.when((kind == "reroute") & (role == "from") & util, F.greatest(F.lit(0.0), value - value * fraction))
        .when((kind == "reroute") & (role == "from") & late, value * 0.9)
        .when((kind == "reroute") & (role == "to") & util, F.least(F.lit(100.0), value + source_util * fraction * 0.7))
        .when((kind == "rate_limit") & util, limited)
        .when((kind == "rate_limit") & loss, F.greatest(F.lit(0.0), value * 0.7))
        .when((kind == "scale_capacity") & util, value / 1.2)
        .otherwise(value)
    )


def rolled_back_value(metric: Column, value: Column) -> Column:
    """A rollback relieves every congested link and every slow one."""
    return (
        F.when((metric == "utilization_pct") & (value > 70.0), value * 0.8)
        .when((metric == "latency_ms") & (value > 20.0), value * 0.85)
        .otherwise(value)
    )


def advanced_value(metric: Column, value: Column, step: Column) -> Column:
    """Value `step` ticks later under mean reversion, in closed form."""
    return (
        F.when(metric == "utilization_pct", 50.0 + (value - 50.0) * F.pow(F.lit(0.95), step))
        .when(metric == "latency_ms", F.greatest(F.lit(0.5), 5.0 + (value - 5.0) * F.pow(F.lit(0.97), step)))
        .otherwise(value)
    )


def apply_action(actions: DataFrame, state: DataFrame) -> DataFrame:
    """Changed rows per action: action_id, entity_id, metric, value (before), applied (after)."""
    rows = relevant_state(actions, state)
    util = state.where(F.col("metric") == "utilization_pct").select(F.col("entity_id").alias("source_link"), F.col("value").alias("_su"))
    rows = rows.join(util, "source_link", "left")
    number = lambda name, default: F.coalesce(
        F.try_element_at("parameters", F.lit(name)).try_cast("double"), F.lit(default)
    )
    after = applied_value(
        F.col("action_type"), F.col("role"), F.col("metric"), F.col("value"), F.coalesce("_su", F.lit(50.0)),
        number("traffic_fraction", TRAFFIC_FRACTION), number("reduction_pct", REDUCTION_PCT),
    )
    return rows.select("action_id", "entity_id", "metric", "value", after.alias("applied"))


def project(applied: DataFrame, steps: int = 5) -> DataFrame:
    """Rows for every step ahead: action_id, entity_id, metric, step, projected."""
    rows = applied.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return rows.withColumn("projected", advanced_value(F.col("metric"), F.col("applied"), F.col("step")))


def _extremes(rows: DataFrame, *keys: str) -> DataFrame:
    """Worst utilisation, latency and loss, and (entity, step) pairs out of service level, from projected rows."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("projected")))
    per = rows.groupBy(*keys, "entity_id", "step").agg(
        pick("utilization_pct").alias("u"), pick("latency_ms").alias("l"), pick("packet_loss_pct").alias("p")
    )
    broken = (F.coalesce("p", F.lit(0.0)) > 1.0) | (F.coalesce("l", F.lit(0.0)) > 50.0)
    top = lambda c: F.coalesce(F.max(c), F.lit(0.0))
    return per.groupBy(*keys).agg(
        top("u").alias("max_util"), top("l").alias("max_latency"), top("p").alias("max_loss"),
        F.count_if(broken).alias("sla_violations"),
    )


def projection_risk(actions: DataFrame, state: DataFrame, steps: int = 5) -> DataFrame:
    """Risk summary per action over the whole projected network.

    What an action leaves alone evolves the same way for all actions, so that part is reduced once: entities are
    ranked per metric, and an action takes the first ranked value it does not change itself.
    """
    changed = apply_action(actions, state)
    own = _extremes(project(changed, steps), "action_id")
    rolled = state.withColumn("applied", rolled_back_value(F.col("metric"), F.col("value")))
    rolled = _extremes(project(rolled, steps)).select(
        *[F.col(c).alias("r_" + c) for c in ("max_util", "max_latency", "max_loss", "sla_violations")]
    )
    calm = project(state.withColumn("applied", F.col("value")), steps)
    everyone = _extremes(calm, "entity_id")
    # An action touches at most two links, so one of the top three per metric is untouched.
    ranks = []
    for name in ("max_util", "max_latency", "max_loss"):
        top = everyone.orderBy(F.desc(name), "entity_id").limit(3)
        ranks.append(top.agg(F.array_sort(F.collect_list(F.struct((-F.col(name)).alias("v"), "entity_id"))).alias("t_" + name)))
    totals = everyone.agg(F.sum("sla_violations").alias("all_sla"))
    touched = changed.select("action_id", "entity_id").distinct()
    spared = touched.join(everyone, "entity_id").groupBy("action_id").agg(
        F.collect_set("entity_id").alias("own_ids"), F.sum("sla_violations").alias("own_sla")
    )
    rows = actions.select("action_id", "action_type").join(own, "action_id", "left").join(spared, "action_id", "left")
    ids = F.coalesce("own_ids", F.array().cast("array<string>"))
    rolling = F.col("action_type") == "config_rollback"
    values = {}
    names = ("max_util", "max_latency", "max_loss")
    rows = rows.withColumns({"own_ids": ids, **{"t_" + n: top.scalar() for n, top in zip(names, ranks)}})
    for name in names:
        others = F.filter("t_" + name, lambda e: ~F.array_contains(F.col("own_ids"), e["entity_id"]))
        rest = F.coalesce(-F.try_element_at(others, F.lit(1))["v"], F.lit(0.0))
        values["w_" + name] = F.when(rolling, rolled.select("r_" + name).scalar()).otherwise(
            F.greatest(F.coalesce(name, F.lit(0.0)), rest)
        )
    everywhere = F.coalesce(totals.scalar(), F.lit(0))
    values["w_sla"] = F.when(rolling, rolled.select("r_sla_violations").scalar()).otherwise(
        everywhere - F.coalesce("own_sla", F.lit(0)) + F.coalesce("sla_violations", F.lit(0))
    )
    rows = rows.withColumns(values)
    util = clamp((F.col("w_max_util") - 50.0) / 50.0, 0.0, 1.0)
    late = clamp((F.col("w_max_latency") - 10.0) / 90.0, 0.0, 1.0)
    loss = F.least(F.lit(1.0), F.col("w_max_loss") / 5.0)
    sla = F.least(F.lit(1.0), F.col("w_sla") / float(max(steps * 2, 1)))
    return rows.select(
        "action_id",
        F.round("w_max_util", 4).alias("max_utilization"),
        F.round(0.4 * util + 0.3 * late + 0.2 * loss + 0.1 * sla, 6).alias("projection_risk"),
        (F.col("w_max_util") < SAFE_UTILIZATION).alias("projection_safe"),
        F.col("w_sla").cast("long").alias("sla_violations"),
    )


def combined_risk(action: Column, projection: Column, projection_safe: Column, causal: Column) -> Column:
    twin = F.when(projection_safe, projection).otherwise(F.greatest(projection, F.lit(0.75)))
    return F.least(F.lit(1.0), F.greatest(action, twin, F.coalesce(causal, F.lit(0.0))))


def policy(actions: DataFrame) -> DataFrame:
    """Low confidence becomes a ticket; otherwise risk and confidence decide whether someone must approve."""
    low = F.col("confidence") < 0.6
    approval = (
        F.when(low, False).when(F.col("risk_level") >= 0.7, True).when(F.col("risk_level") < 0.4, False)
        .otherwise(F.col("confidence") < 0.85)
    )
    return actions.withColumns({
        "requires_approval": approval,
        "decided_type": F.when(low, "create_ticket").otherwise(F.col("action_type")),
        "decided_risk": F.when(low, 0.0).otherwise(F.col("risk_level")),
    })


def needs_review(kind: Column, risk: Column, confidence: Column) -> Column:
    return (risk >= 0.7) | (kind.isin("reroute", "config_rollback") & (confidence < 0.85))


def needs_person(uncertainty: Column) -> Column:
    return uncertainty > 0.3


def rank_actions(actions: DataFrame, key: str = "incident_id") -> DataFrame:
    """Safe actions first, then utility. `rank_parity` is by utility alone."""
    rows = best_rows(actions, [key], [F.desc("utility_score"), F.col("action_id")], None, "rank_parity")
    return best_rows(rows, [key], [F.desc("is_safe"), F.desc("utility_score"), F.col("action_id")], None)


def engine_payload(kind: Column, params: Column, target_link: Column) -> Column:
    """Parameters as the execution layer takes them, as text."""
    get = lambda name: F.try_element_at(params, F.lit(name))
    number = lambda name, default: F.coalesce(get(name).try_cast("double"), F.lit(default))
    return (
        F.when(kind == "reroute", F.to_json(F.struct(
            F.lit("reroute").alias("action_type"),
            F.coalesce(get("source_node"), endpoint(target_link, 0)).alias("source_node"),
            F.coalesce(get("target_node"), endpoint(target_link, 1)).alias("target_node"),
            number("new_weight", NEW_WEIGHT).alias("new_weight"))))
        .when(kind == "rate_limit", F.to_json(F.struct(
            F.lit("rate_limit").alias("action_type"),
            F.coalesce(get("target_link"), target_link).alias("target_link"), number("limit_pct", LIMIT_PCT).alias("limit_pct"))))
        .when(kind == "scale_capacity", F.to_json(F.struct(
            F.lit("scale_capacity").alias("action_type"),
            F.coalesce(get("target_link"), target_link).alias("target_link"),
            number("new_capacity_gbps", 100.0).alias("new_capacity_gbps"))))
        .otherwise(F.to_json(F.map_concat(F.create_map(F.lit("action_type"), kind), F.coalesce(params, F.create_map().cast("map<string,string>")))))
    )


def action_entities(actions: DataFrame) -> DataFrame:
    """(action_id, entity_id): targets, parameter links and nodes, and the ends of every link among them."""
    get = lambda name: F.try_element_at("parameters", F.lit(name))
    named = F.array_compact(F.array(
        F.col("target_node"), F.col("target_link"), get("from_link"), get("to_link"), get("target_link"),
        get("source_node"), get("target_node"),
    ))
    every = F.flatten(F.transform(named, lambda e: F.when(e.contains("-"), F.concat(F.array(e), F.slice(F.split(e, "-"), 1, 2))).otherwise(F.array(e))))
    return actions.select("action_id", F.explode(F.array_distinct(every)).alias("entity_id")).where(F.col("entity_id") != "")


def passive(kind: Column) -> Column:
    return kind.isin(*PASSIVE_ACTIONS)


def suggest_reroute(state: DataFrame, *keys: str, limit: float = 80.0) -> DataFrame:
    """Reroute the most used link when it is at or above `limit`."""
    util = state.where(F.col("metric") == "utilization_pct")
    worst = util.groupBy(*keys).agg(
        F.max_by("entity_id", F.struct("value", "entity_id")).alias("worst"), F.max("value").alias("worst_util")
    )
    hot = F.col("worst_util") >= limit
    return worst.select(
        *keys, F.when(hot, "reroute").otherwise("no_action").alias("action_type"),
        F.when(hot, F.col("worst")).alias("target_link"), F.when(hot, 0.6).otherwise(0.5).alias("confidence"),
        F.round("worst_util", 4).alias("worst_util"),
    )


def penalty_score(state: DataFrame, *keys: str) -> DataFrame:
    """Reward of a snapshot: minus the weighted excess of utilisation, latency and loss."""
    def excess(metric, limit, value):
        hit = (F.col("metric") == metric) & (F.col("value") > limit)
        return F.coalesce(F.sum(F.when(hit, value)), F.lit(0.0))
    v = F.col("value")
    total = (
        0.4 * excess("utilization_pct", 80.0, (v - 80.0) / 20.0)
        + 0.3 * excess("latency_ms", 30.0, (v - 30.0) / 20.0)
        + 0.2 * excess("packet_loss_pct", 0.5, v)
        + 0.1 * F.count_if((F.col("metric") == "packet_loss_pct") & (v > 0.5))
    )
    return state.groupBy(*keys).agg((-total).alias("reward"))

"""Safety constraints as predicates over (actions, state, predicted) tables, and the verdict that joins them.

A constraint is a callable `SafetyInput -> DataFrame(action_id, ok, detail)`. Actions a constraint does not
return are satisfied. Links an action does not change keep their current value, so every check below is a count over
the whole network, corrected by the few links the action does change.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwarden.operators.paths import second_paths
from tickwarden.operators.series import chunked, hottest, with_position
from tickwarden.operators.whatif import Effect, action_link, predicted_value
from tickwarden.session import cut

# Limits.
UTIL_LIMIT, CASCADE_LIMIT = 85.0, 80.0
CUSTOMER_SHARE, CAPACITY_SHARE = 0.05, 0.20
WINDOW_MINUTES, MAX_ACTIONS, MIN_PATHS = 10, 3, 2
INERT = ("escalate", "create_ticket", "notify")


@dataclass
class SafetyInput:
    """actions: action_id, action_type, target_node, target_link, parameters [, ts].
    state: entity_id, metric, value. predicted: action_id, entity_id, metric, predicted, or the `Effect` of the actions;
    constraints read `effect`, and `predicted` is then every row of it, formed when a constraint asks for it.
    history: ts of executed actions, or None."""

    actions: DataFrame
    state: DataFrame
    predicted: DataFrame | Effect
    nodes: DataFrame
    links: DataFrame
    history: DataFrame | None = None

    def __post_init__(self) -> None:
        self.effect = self.predicted if isinstance(self.predicted, Effect) else Effect(self.predicted)
        if self.effect is self.predicted:
            del self.predicted

    @cached_property
    def changed_alike(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return _changed_alike(self)

    def __getattr__(self, name: str) -> DataFrame:
        if name != "predicted":
            raise AttributeError(name)
        self.predicted = self.effect.all_rows().select("action_id", "entity_id", "metric", "predicted")
        return self.predicted


Constraint = Callable[[SafetyInput], DataFrame]


def _utilization(given: SafetyInput) -> DataFrame:
    now = given.state.where(F.col("metric") == "utilization_pct").select(F.col("entity_id").alias("link_id"), F.col("value").alias("current"))
    return given.links.select("link_id").distinct().join(now, "link_id", "left").withColumn("current", F.coalesce("current", F.lit(0.0)))


def _changed(given: SafetyInput, rows: DataFrame | None = None) -> DataFrame:
    """(action_id, link_id, current, predicted) for links with a predicted utilisation, by default one of their own."""
    ahead = (given.effect.rows if rows is None else rows).where(F.col("metric") == "utilization_pct").select("action_id", F.col("entity_id").alias("link_id"), "predicted")
    return ahead.join(_utilization(given), "link_id")


def _changed_alike(given: SafetyInput) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `_changed` leaves to groups: groups (action_id, group, delta, apart), their links (group, leaf, link_id, current,
    value), and the links told apart (action_id, group, link_id, current, predicted) that do not follow their group."""
    util = F.col("metric") == "utilization_pct"
    groups = given.effect.groups.where(util).select("action_id", "group", "delta", "apart")
    members = given.effect.members.where(util).select("group", "leaf", F.col("entity_id").alias("link_id"), "value")
    members = cut(members.join(_utilization(given), "link_id"))
    apart = groups.withColumn("leaf", F.explode("apart")).join(members, ["group", "leaf"])
    apart = apart.withColumn("predicted", predicted_value(F.col("value"), F.col("delta")))
    return groups, members, cut(apart.select("action_id", "group", "link_id", "current", "predicted"))


def _counts(given: SafetyInput, above: float, below: float | None = None) -> DataFrame:
    """(action_id, was, is): changed links with more than `above` before and after, among those that now have less than `below`."""
    over = lambda c: F.when(F.col(c) > above, 1).otherwise(0)
    among = F.lit(True) if below is None else F.col("current") < below
    parts = _changed(given).where(among).select("action_id", over("current").alias("was"), over("predicted").alias("is"))
    if given.effect.groups is not None:
        groups, members, apart = given.changed_alike
        members = members.where(among)
        was = groups.join(members.groupBy("group").agg(F.sum(over("current")).alias("was")), "group")
        now = count_above(groups.select("action_id", "group", "delta"), members, above)
        parts = parts.unionByName(was.select("action_id", "was", F.lit(0).alias("is")))
        parts = parts.unionByName(now.select("action_id", F.lit(0).alias("was"), F.col("n").alias("is")))
        parts = parts.unionByName(apart.where(among).select("action_id", (-over("current")).alias("was"), (-over("predicted")).alias("is")))
    return parts.groupBy("action_id").agg(F.sum("was").alias("was"), F.sum("is").alias("is"))


def count_above(groups: DataFrame, members: DataFrame, limit: float) -> DataFrame:
    """(action_id, n): members whose value plus the group's delta is predicted above the limit, in parts that add up.

    Values and the least value that gets there meet in steps of a millionth. What lies two steps above is counted by a
    running sum over the group's values; the few around are compared one by one.
    """
    def step(value):
        return F.floor(F.greatest(F.lit(-4e18), F.least(F.lit(4e18), value * 1e6))).cast("long")
    levels = cut(members.where("value IS NOT NULL").groupBy("group", "value").agg(F.count("*").alias("n")).withColumn("at", step(F.col("value"))))
    asked = cut(groups.withColumn("at", step(F.when(F.isnan("delta"), -4e18).otherwise(limit + 0.00005 - F.col("delta")))))
    none = F.lit(None).cast("string")
    events = levels.select("group", "at", F.lit(0).alias("kind"), "value", "n", none.alias("action_id")).unionByName(
        asked.select("group", (F.col("at") + 2).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("n"), "action_id"))
    events = events.withColumns({"_down": -F.col("at"), "_id": F.monotonically_increasing_id()})
    summed = running_sum(cut(events), ["group"], ["_down", "kind", "action_id", "value", "_id"], "n", "above")
    near = asked.withColumn("at", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1))).join(levels, ["group", "at"])
    near = near.where(predicted_value(F.col("value"), F.col("delta")) > limit)
    return summed.where("kind = 1").select("action_id", F.col("above").alias("n")).unionByName(near.select("action_id", "n"))


def merge_states(state: DataFrame, predicted: DataFrame | Effect, zero_is_missing: bool = False) -> DataFrame:
    """Predicted values over current ones, per (action, entity, metric) an action changes.

    `zero_is_missing` treats a predicted 0.0 as no prediction. The state is joined to rows of `predicted`, or to the readings
    of an effect, which are fewer than the rows it has; these are then written without a shuffle.
    """
    value = F.col("predicted")
    if zero_is_missing:
        value = F.when(value != 0.0, value)
    given = predicted if isinstance(predicted, Effect) else Effect(predicted)
    rows = given.beside(state.select("entity_id", "metric", F.col("value").alias("_c"))).all_rows()
    return rows.select("action_id", "entity_id", "metric", F.coalesce(value, "_c").alias("value"))


def max_link_utilization(given: SafetyInput) -> DataFrame:
    now = _utilization(given).agg(F.count_if(F.col("current") > UTIL_LIMIT).alias("n")).scalar()
    own = _counts(given, UTIL_LIMIT)
    rows = given.actions.where(~F.col("action_type").isin(*INERT)).select("action_id").join(own, "action_id", "left")
    count = now - F.coalesce("was", F.lit(0)) + F.coalesce("is", F.lit(0))
    return rows.select("action_id", (count == 0).alias("ok"), F.format_string("%d links above %.0f%%", count, F.lit(UTIL_LIMIT)).alias("detail"))


def no_cascading_overload(given: SafetyInput) -> DataFrame:
    own = _counts(given, CASCADE_LIMIT, CASCADE_LIMIT).select("action_id", F.col("is").alias("n"))
    rows = given.actions.where(~F.col("action_type").isin(*INERT)).select("action_id").join(own, "action_id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("action_id", (n == 0).alias("ok"), F.format_string("%d healthy links pushed above %.0f%%", n, F.lit(CASCADE_LIMIT)).alias("detail"))


def touched_nodes(given: SafetyInput) -> DataFrame:
    """(action_id, node_id): ends of the action's link and its target node."""
    link, _ = action_link(F.col("action_type"), F.col("parameters"), F.col("target_link"))
    named = given.actions.select("action_id", F.coalesce("target_link", link).alias("link_id"), "target_node")
    ends = named.join(given.links.select("link_id", "source", "target"), "link_id").select(
        "action_id", F.explode(F.array("source", "target")).alias("node_id")
    )
    own = named.where(F.col("target_node").isNotNull()).select("action_id", F.col("target_node").alias("node_id"))
    return ends.unionByName(own).distinct()


def customer_isolation(given: SafetyInput) -> DataFrame:
    everyone = given.nodes.agg(F.sum("customers")).scalar()
    behind = given.nodes.groupBy(F.col("node_id").alias("entity_id")).agg(F.sum("customers").alias("w"))
    hit = given.effect.total(behind, touched_nodes(given).withColumnRenamed("node_id", "entity_id"), "c")
    rows = given.actions.select("action_id").join(hit, "action_id", "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long")))
    rows = rows.withColumn("_all", F.greatest(F.coalesce(everyone, F.lit(0)), F.lit(1)))
    share = F.format_string("%d customers affected of %d, limit %.0f%%", "c", "_all", F.lit(CUSTOMER_SHARE * 100))
    return rows.select("action_id", (F.col("c") <= F.col("_all") * CUSTOMER_SHARE).alias("ok"), share.alias("detail"))


def recent_actions(actions: DataFrame, history: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """(action_id, recent): executed actions in the trailing window of each action, both ends inclusive.

    Executed actions enter, and leave after the window; the running sum over both is the count. The sum is split
    over chunks of the global time order, so a burst of actions does not end in one task.
    """
    window = F.expr(f"INTERVAL {minutes} MINUTES")
    none = F.lit(None).cast("string")
    events = (
        history.select(F.col("ts").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step"), none.alias("action_id"))
        .unionByName(actions.select(F.col("ts").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("step"), "action_id"))
        .unionByName(history.select((F.col("ts") + window).alias("at"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), none.alias("action_id")))
    )
    summed = running_sum(events.withColumn("_all", F.lit(0)), ["_all"], ["at", "kind", "action_id"], "step", "recent")
    return summed.where(F.col("kind") == 1).select("action_id", "recent")


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, max_rows: int = 200_000, chunk_rows: int = 65_536
) -> DataFrame:
    """Running sum per key. Above `max_rows` per key: per-chunk sums, then an offset per chunk."""
    size = hottest(df, keys)
    if size <= max_rows:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = chunked(with_position(df, keys, order, max_rows, size), 0, 0, chunk_rows).drop("halo")
    sums = rows.groupBy(*keys, "chunk").agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "chunk", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys, "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.sum(value).over(local)).join(sums, [*keys, "chunk"])
    return rows.withColumn(name, F.col("_local") + F.col("_offset")).drop("_local", "_offset", "pos", "chunk")


def rate_limit_cap(given: SafetyInput) -> DataFrame:
    if given.history is None or "ts" not in given.actions.columns:
        return given.actions.select("action_id", F.lit(True).alias("ok"), F.lit("no executed actions").alias("detail"))
    rows = recent_actions(given.actions, given.history)
    detail = F.format_string("%d actions in last %d min (limit %d)", "recent", F.lit(WINDOW_MINUTES), F.lit(MAX_ACTIONS))
    return rows.select("action_id", (F.col("recent") < MAX_ACTIONS).alias("ok"), detail.alias("detail"))


def moved_traffic(given: SafetyInput) -> DataFrame:
    """(action_id, moved_gbps) from the parameters of reroute and rate-limit actions."""
    number = lambda name, default: F.coalesce(
        F.try_element_at("parameters", F.lit(name)).try_cast("double"), F.lit(default)
    )
    link, _ = action_link(F.col("action_type"), F.col("parameters"), F.col("target_link"))
    rows = given.actions.select("action_id", "action_type", link.alias("link_id"), number("traffic_fraction", 0.5).alias("f"), number("reduction_pct", 20.0).alias("r"))
    rows = rows.join(given.links.select("link_id", "capacity_gbps"), "link_id", "left").join(_utilization(given), "link_id", "left")
    ahead = _changed(given).select("action_id", "link_id", "predicted")
    if given.effect.groups is not None:
        groups, members, _ = given.changed_alike
        alike = rows.select("action_id", "link_id").join(members, "link_id").join(groups, ["action_id", "group"]).where(~F.array_contains("apart", F.col("leaf")))
        ahead = ahead.unionByName(alike.select("action_id", "link_id", predicted_value(F.col("value"), F.col("delta")).alias("predicted")))
    rows = rows.join(ahead, ["action_id", "link_id"], "left")
    capacity, util = F.coalesce("capacity_gbps", F.lit(0.0)), F.coalesce("predicted", "current", F.lit(0.0))
    moved = (
        F.when(F.col("action_type") == "reroute", capacity * util / 100.0 * F.col("f"))
        .when(F.col("action_type") == "rate_limit", capacity * F.col("r") / 100.0)
        .otherwise(0.0)
    )
    return rows.select("action_id", moved.alias("moved_gbps"))


def blast_radius_cap(given: SafetyInput) -> DataFrame:
    rows = moved_traffic(given).withColumn("_all", given.links.agg(F.sum("capacity_gbps")).scalar())
    detail = F.format_string("%.1f Gbps affected of %.0f Gbps, limit %.0f%%", "moved_gbps", "_all", F.lit(CAPACITY_SHARE * 100))
    return rows.select("action_id", (F.col("moved_gbps") <= F.col("_all") * CAPACITY_SHARE).alias("ok"), detail.alias("detail"))


def rollback_path_exists(given: SafetyInput) -> DataFrame:
    """Actions that take a link away need two paths between its ends; reroute and rate limit keep the link."""
    keeps = F.col("action_type").isin("reroute", "rate_limit")
    rest = given.actions.where(~keeps & F.col("target_link").isNotNull()).select("action_id", F.col("target_link").alias("link_id"))
    ways = rest.join(given.links.select("link_id", "source", "target"), "link_id").join(second_paths(given.links), "link_id")
    detail = F.format_string("%s→%s: %s", "source", "target", F.when(F.col("second"), "another path remains").otherwise("no other path"))
    return ways.select("action_id", F.col("second").alias("ok"), detail.alias("detail"))


def default_constraints() -> dict[str, Constraint]:
    """A fresh registry; add, replace or delete entries to change what `verify` checks."""
    return {
        "max_link_utilization": max_link_utilization,
        "no_cascading_overload": no_cascading_overload,
        "customer_isolation": customer_isolation,
        "rate_limit_cap": rate_limit_cap,
        "blast_radius_cap": blast_radius_cap,
        "rollback_path_exists": rollback_path_exists,
    }


def verify(given: SafetyInput, constraints: dict[str, Constraint] | None = None) -> DataFrame:
    """Verdict per action: is_safe, violations (constraint names), details (name -> text) and proof."""
    rules = default_constraints() if constraints is None else constraints
    if not rules:
        none = F.array().cast("array<string>")
        return given.actions.select("action_id", F.lit(True).alias("is_safe"), none.alias("violations"))
    checks = [rule(given).select("action_id", F.lit(name).alias("name"), F.lit(i).alias("i"), "ok", "detail") for i, (name, rule) in enumerate(rules.items())]
    rows = reduce(DataFrame.unionByName, checks)
    entry = F.struct("i", "name", "ok", "detail")
    found = rows.groupBy("action_id").agg(F.array_sort(F.collect_list(entry)).alias("checks"))
    link, _ = action_link(F.col("action_type"), F.col("parameters"), F.col("target_link"))
    target = F.coalesce("target_link", link, "target_node", F.lit("?"))
    out = given.actions.select("action_id", "action_type", target.alias("_target")).join(found, "action_id", "left")
    checks_ = F.coalesce("checks", F.array().cast("array<struct<i:int,name:string,ok:boolean,detail:string>>"))
    broken = F.filter(checks_, lambda c: ~c["ok"])
    out = out.withColumns({"_broken": broken, "_checks": checks_})
    lines = lambda c, mark: F.transform(c, lambda e: F.concat(F.lit(f"    {mark}  "), e["name"], F.lit(": "), e["detail"]))
    approved = F.concat(
        F.array(
            F.format_string("Action APPROVED [%s on %s]", "action_type", "_target"),
            F.format_string("    All %d safety constraints satisfied.", F.lit(len(rules))),
        ),
        lines(F.col("_checks"), "✓"),
    )
    blocked = F.concat(
        F.array(
            F.format_string("Action BLOCKED [%s on %s]", "action_type", "_target"),
            F.format_string("    %d/%d constraint(s) violated.", F.size("_broken"), F.lit(len(rules))),
        ),
        lines(F.col("_broken"), "✗"),
    )
    safe = F.size("_broken") == 0
    return out.select(
        "action_id", safe.alias("is_safe"),
        F.transform("_broken", lambda c: c["name"]).alias("violations"),
        F.map_from_entries(F.transform("_checks", lambda c: F.struct(c["name"], c["detail"]))).alias("details"),
        F.array_join(F.when(safe, approved).otherwise(blocked), "\n").alias("proof"),
    )


def explain(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("action_id", F.coalesce("proof", F.lit("No proof available.")).alias("explanation"))


def first_gap(taken: DataFrame, keys: list[str], place: str) -> DataFrame:
    """(keys, gap): the first place, from 0, that a key's rows leave free. Sorted, distinct places equal their own numbers up to there."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(place)) - 1
    rows = taken.select(*keys, place).distinct().withColumn("_number", number)
    return rows.groupBy(*keys).agg(F.count_if(F.col(place) == F.col("_number")).alias("gap"))


def _highest_alike(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(action_id, link_id, predicted): of each group that an action moves, the link that was highest, leaves told apart left out.

    It is highest afterwards too; of links that come to the same value, it stands for all.
    """
    leaves = members.groupBy("group", "leaf").agg(F.max(F.struct("value", "link_id")).alias("top"))
    leaves = cut(with_position(cut(leaves), ["group"], [F.desc("top")]))
    held = groups.select("action_id", "group", F.explode("apart").alias("leaf")).join(leaves.select("group", "leaf", "pos"), ["group", "leaf"])
    free = groups.select("action_id", "group", "delta").join(first_gap(held, ["action_id", "group"], "pos"), ["action_id", "group"], "left")
    free = free.withColumn("pos", F.coalesce("gap", F.lit(0))).join(leaves.select("group", "pos", "top"), ["group", "pos"])
    return free.select("action_id", F.col("top.link_id").alias("link_id"), predicted_value(F.col("top.value"), F.col("delta")).alias("predicted"))


def worst_link(given: SafetyInput) -> DataFrame:
    """(action_id, worst_link, worst_util) after each action.

    The network is ranked once, and so are the links of each group that actions move alike; links of no group are one
    more. What an action leaves alone is the highest of: the best link of the first group it does not touch, groups being
    ranked by their best links; the first gap among the links it changes of a group that it does not move; links
    told apart from a group that it moves. That one competes with what the action changes, one link for a group.
    """
    changed = cut(_changed(given).select("action_id", "link_id", "predicted"))
    ranked = _utilization(given).withColumns({"_all": F.lit(0), "_down": -F.col("current")})
    ranked = with_position(ranked, ["_all"], ["_down", "link_id"]).select("link_id", "current", F.col("pos").alias("rank"))
    ahead, moved, spared = changed, None, None
    if given.effect.groups is None:
        ranked = ranked.withColumn("group", F.lit(""))
    else:
        groups, members, apart = given.changed_alike
        ranked = ranked.join(members.select("link_id", "group").distinct(), "link_id", "left").withColumn("group", F.coalesce("group", F.lit("")))
        ahead = changed.unionByName(_highest_alike(groups, members))
        moved = groups.select("action_id", "group").distinct()
        spared = apart.select("action_id", "link_id").join(changed, ["action_id", "link_id"], "left_anti")
    ranked = cut(with_position(cut(ranked), ["group"], ["rank"]).withColumnRenamed("pos", "place"))
    best = with_position(ranked.where("place = 0").withColumn("_all", F.lit(0)), ["_all"], ["rank"])
    best = cut(best.select("group", "pos", "rank", "link_id", "current"))
    own = cut(changed.select("action_id", "link_id").distinct().join(ranked.select("link_id", "group", "place"), "link_id"))

    touched, single = own.select("action_id", "group"), own
    if moved is not None:
        touched, single = touched.unionByName(moved), own.join(moved, ["action_id", "group"], "left_anti")
    untouched = first_gap(touched.join(best.select("group", "pos"), "group"), ["action_id"], "pos")
    untouched = given.actions.select("action_id").distinct().join(untouched, "action_id", "left").withColumn("pos", F.coalesce("gap", F.lit(0)))
    entry = F.struct("rank", F.col("link_id").alias("link"), F.col("current").alias("util")).alias("rest")
    rest = untouched.join(best, "pos").select("action_id", entry)
    single = first_gap(single, ["action_id", "group"], "place").withColumnRenamed("gap", "place")
    rest = rest.unionByName(single.join(ranked, ["group", "place"]).select("action_id", entry))
    if spared is not None:
        rest = rest.unionByName(spared.join(ranked, "link_id").select("action_id", entry))

    highest = ahead.groupBy("action_id").agg(F.max(F.struct(F.col("predicted").alias("v"), F.col("link_id"))).alias("own"))
    rows = given.actions.select("action_id").join(highest, "action_id", "left").join(rest.groupBy("action_id").agg(F.min("rest").alias("rest")), "action_id", "left")
    mine = F.coalesce(F.col("own.v"), F.lit(-1.0)) >= F.coalesce("rest.util", F.lit(-1.0))
    return rows.select(
        "action_id", F.when(mine, F.col("own.link_id")).otherwise(F.col("rest.link")).alias("worst_link"),
        F.when(mine, F.col("own.v")).otherwise(F.col("rest.util")).alias("worst_util"),
    )

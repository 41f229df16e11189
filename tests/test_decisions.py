import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import minute
from tickwarden.operators import causal as C
from tickwarden.operators import outcomes as O
from tickwarden.operators import safety as S
from tickwarden.operators import whatif as W

ACTION = "action_id string, action_type string, target_node string, target_link string, parameters map<string,string>"


def state_of(spark, values):
    return spark.createDataFrame([(e, m, float(v)) for (e, m), v in values.items()], "entity_id string, metric string, value double")


def predictions(spark, values):
    return spark.createDataFrame([(a, e, "utilization_pct", float(v)) for (a, e), v in values.items()], "action_id string, entity_id string, metric string, predicted double")


def busy(links, **over):
    values = {(r["link_id"], "utilization_pct"): 50.0 for r in links.collect()}
    values.update({(k.replace("_", "-"), "utilization_pct"): v for k, v in over.items()})
    return values


def test_worked_safety_examples(spark, nodes, links):
    actions = spark.createDataFrame([
        ("A", "reroute", None, "CR1-CR2", {"from_link": "CR1-CR2", "to_link": "AGG2-CR1", "traffic_fraction": "0.3"}),
        ("B", "reroute", None, "CR1-CR2", {"from_link": "CR1-CR2", "to_link": "AGG2-CR1", "traffic_fraction": "0.3"}),
        ("C", "rate_limit", None, "AGG1-CR1", {"reduction_pct": "20"}),
        ("D", "scale_capacity", None, "AGG1-EDGE1", {}), ("E", "create_ticket", None, None, {}),
    ], ACTION)
    state = state_of(spark, busy(links, CR1_CR2=70.0, AGG2_CR1=70.0, AGG1_CR1=82.0))
    predicted = predictions(spark, {("A", "CR1-CR2"): 49.2, ("A", "AGG2-CR1"): 62.8, ("B", "CR1-CR2"): 49.2, ("B", "AGG2-CR1"): 91.0, ("C", "AGG1-CR1"): 62.0})
    given = S.SafetyInput(actions, state, predicted, nodes, links)
    out = {r["action_id"]: r for r in S.verify(given).collect()}
    assert out["A"]["is_safe"] and "APPROVED" in out["A"]["proof"]
    assert out["B"]["violations"] == ["max_link_utilization", "no_cascading_overload"] and "BLOCKED" in out["B"]["proof"]
    assert out["C"]["is_safe"] and out["E"]["is_safe"]
    assert out["D"]["violations"] == ["customer_isolation", "rollback_path_exists"]
    worst = {r["action_id"]: (r["worst_link"], r["worst_util"]) for r in S.worst_link(given).collect()}
    assert worst["B"] == ("AGG2-CR1", 91.0) and worst["E"] == ("AGG1-CR1", 82.0) and worst["C"] == ("AGG2-CR1", 70.0)


def test_constraints_can_be_added_and_removed(spark, nodes, links):
    actions = spark.createDataFrame([("A", "reroute", None, "CR1-CR2", {"from_link": "CR1-CR2"})], ACTION)
    given = S.SafetyInput(actions, state_of(spark, busy(links, CR1_CR2=95.0)), predictions(spark, {("zz", "q"): 0.0}), nodes, links)
    rules = S.default_constraints()
    assert list(rules) == ["max_link_utilization", "no_cascading_overload", "customer_isolation", "rate_limit_cap", "blast_radius_cap", "rollback_path_exists"]
    del rules["max_link_utilization"]
    assert S.verify(given, rules).first()["is_safe"]
    rules["never"] = lambda g: g.actions.select("action_id", F.lit(False).alias("ok"), F.lit("no").alias("detail"))
    assert S.verify(given, rules).first()["violations"] == ["never"]


@pytest.mark.parametrize("limit", [10, 100000])
def test_trailing_count_against_brute_force(spark, limit, monkeypatch):
    rng = random.Random(1)
    done = [rng.choice([0, 5, 60]) * 0.5 + rng.randint(0, 40) for _ in range(80)]
    asked = [rng.randint(0, 45) for _ in range(60)]
    history = spark.createDataFrame([(minute(t),) for t in done], "ts timestamp")
    actions = spark.createDataFrame([(f"a{i}", minute(t)) for i, t in enumerate(asked)], "action_id string, ts timestamp")
    whole = S.running_sum
    monkeypatch.setattr(S, "running_sum", lambda *a: whole(*a, max_rows=limit, chunk_rows=16))
    got = {r["action_id"]: r["recent"] for r in S.recent_actions(actions, history).collect()}
    assert got == {f"a{i}": sum(t - 10 <= x <= t for x in done) for i, t in enumerate(asked)}


def test_projection_known_answers(spark):
    state = state_of(spark, {("A-B", "utilization_pct"): 95.0, ("A-C", "utilization_pct"): 20.0, ("A-B", "latency_ms"): 4.0})
    actions = spark.createDataFrame([
        ("r", "reroute", None, "A-B", {"from_link": "A-B", "to_link": "A-C", "traffic_fraction": "0.3"}),
        ("t", "create_ticket", None, None, {}), ("b", "config_rollback", None, "A-B", {}), ("l", "rate_limit", None, "A-B", {}),
    ], ACTION)
    steps = {(r["action_id"], r["entity_id"], r["metric"], r["step"]): r["projected"] for r in W.project(W.apply_action(actions, state)).collect()}
    assert steps[("r", "A-B", "utilization_pct", 1)] == pytest.approx(65.675)
    assert steps[("r", "A-C", "utilization_pct", 1)] == pytest.approx(50 + (20 + 95 * 0.3 * 0.7 - 50) * 0.95)
    five = 50 + 45 * 0.95**5
    assert five == pytest.approx(84.820142, abs=1e-6)
    risk = {r["action_id"]: r for r in W.projection_risk(actions, state).collect()}
    assert risk["t"]["max_utilization"] == pytest.approx(50 + 45 * 0.95, abs=1e-4) and not risk["t"]["projection_safe"]
    assert risk["r"]["max_utilization"] == pytest.approx(65.675, abs=1e-4) and risk["r"]["projection_safe"]
    assert risk["b"]["max_utilization"] == pytest.approx(50 + (76 - 50) * 0.95, abs=1e-4)
    assert risk["l"]["max_utilization"] == pytest.approx(50 + (76 - 50) * 0.95, abs=1e-4)


def test_counterfactual_modes(spark, nodes, links):
    values = busy(links, CR1_CR2=90.0)
    values |= {("CR1-CR2", "packet_loss_pct"): 1.0, ("CR1-CR2", "latency_ms"): 9.0}
    state = state_of(spark, values)
    actions = spark.createDataFrame([("l", "rate_limit", None, "CR1-CR2", {"reduction_pct": "20"}), ("x", "escalate", None, None, {})], ACTION)
    graph = C.structural_graph(nodes, links).cut()
    full = {(r["entity_id"], r["metric"]): r["predicted"] for r in W.counterfactual(actions, state, graph).collect()}
    assert full[("CR1-CR2", "packet_loss_pct")] == 0.0 and full[("CR1-CR2", "utilization_pct")] < 90
    compat = {(r["entity_id"], r["metric"]) for r in W.counterfactual(actions, state, graph, compat=True).collect()}
    assert ("CR1-CR2", "packet_loss_pct") not in compat and ("CR1-CR2", "latency_ms") in compat
    assert W.counterfactual_risk(W.counterfactual(actions, state, graph)).first()["causal_risk"] == 0.0


def test_effects_do_not_tell_leaves_of_a_hub_apart(spark):
    rng = random.Random(3)
    ends = [("R0", "N0"), ("R0", "N1"), ("R0", "N2"), ("N0", "N1")] + [(f"N{i % 3}", f"U{i}") for i in range(90)]
    links = spark.createDataFrame([("-".join(sorted(e)), *e, 40.0) for e in ends], "link_id string, source string, target string, capacity_gbps double").cache()
    kinds = {"R": "core", "N": "aggregation", "U": "edge"}
    nodes = spark.createDataFrame([(n, kinds[n[0]], rng.randint(0, 9)) for n in sorted({n for e in ends for n in e})], "node_id string, node_type string, customers bigint").cache()
    ids = ["-".join(sorted(e)) for e in ends]
    values = {(e, "utilization_pct"): rng.choice([0.0, 12.5, 84.0, 79.99995, 85.00005, 91.0]) for e in ids}
    values |= {(e, "packet_loss_pct"): rng.random() for e in ids[::2]} | {(f"U{i}", "latency_ms"): 9.0 for i in range(0, 90, 4)}
    state = state_of(spark, values)
    actions = spark.createDataFrame(
        [(f"l{i}", "rate_limit", None, ids[i], {"reduction_pct": r}) for i, r in ((0, "9"), (3, "0.5"), (7, "20"), (20, "0.02"))]
        + [("r", "reroute", None, ids[9], {"from_link": ids[9], "to_link": ids[10], "traffic_fraction": "0.3"}),
           ("up", "rate_limit", None, ids[30], {"reduction_pct": "-3"}), ("x", "escalate", None, None, {})], ACTION)
    told = W.effect(actions, state, C.structural_graph(nodes, links))
    plain = W.effect(actions, state, C.structural_graph(nodes, links, max_degree=1000))
    assert plain.groups is None and told.rows.count() + told.groups.count() < plain.rows.count() / 5
    rows = lambda x: sorted((r["action_id"], r["entity_id"], r["metric"], round(r["predicted"], 3), round(r["delta"], 6)) for r in x.collect())
    assert rows(told.all_rows()) == rows(plain.rows)
    risk = lambda x: sorted(map(tuple, W.counterfactual_risk(x).collect()))
    assert risk(told) == risk(plain) == risk(plain.rows)
    given = lambda x: S.SafetyInput(actions, state, x, nodes, links)
    verdicts = lambda x: sorted((r["action_id"], r["is_safe"], r["violations"], sorted(r["details"].items())) for r in S.verify(given(x)).collect())
    assert verdicts(told) == verdicts(plain.rows)
    worst = lambda x: sorted((r["action_id"], r["worst_link"], round(r["worst_util"], 3)) for r in S.worst_link(given(x)).collect())
    assert worst(told) == worst(plain.rows)


def test_the_state_meets_readings_before_they_are_repeated_per_action(spark):
    ends = [("H", f"U{i}") for i in range(14)] + [("H", "K"), ("K", "V0"), ("K", "V1"), ("K", "V2")]
    links = spark.createDataFrame([("-".join(sorted(e)), *e) for e in ends], "link_id string, source string, target string")
    nodes = spark.createDataFrame([(n, "edge") for n in sorted({n for e in ends for n in e})], "node_id string, node_type string")
    rows = [("-".join(sorted(e)), m, v) for e in ends for m, v in (("utilization_pct", 3.0 + len(e[1])), ("latency_ms", 1.0), ("packet_loss_pct", 0.5))]
    state = spark.createDataFrame(rows, "entity_id string, metric string, value double")
    now = spark.createDataFrame(rows[4:] + rows[6:9], "entity_id string, metric string, value double")  # some are missing, some stand there twice
    none = {"target_node": None, "parameters": {"reduction_pct": "30"}}
    actions = spark.createDataFrame([{"action_id": f"a{i}", "action_type": "rate_limit", "target_link": f"H-U{i}", **none} for i in range(4)],
                                    "action_id string, action_type string, target_link string, target_node string, parameters map<string,string>")
    show = lambda rows: sorted((r["action_id"], r["entity_id"], r["metric"], None if r["value"] is None else round(r["value"], 6)) for r in rows.collect())
    hubs = W.effect(actions, state, C.structural_graph(nodes, links, max_degree=2))
    assert hubs.groups is not None and hubs.groups.count() > 0
    for zero in (False, True):
        merged = S.merge_states(now, hubs, zero)
        plain = S.merge_states(now, W.counterfactual(actions, state, C.structural_graph(nodes, links, max_degree=1000)), zero)
        assert show(merged) == show(plain)
    # The state is joined below the grid that repeats readings per action.
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("LeftOuter") > plan.rindex("RepartitionByExpression")


def test_worst_link_reads_a_group_by_its_highest_links(spark, monkeypatch):
    rng = random.Random(5)
    ids = [f"L{i:02}" for i in range(24)]
    value = {e: rng.choice([10.0, 20.0, 30.0, 40.0, 55.5]) for e in ids}
    home = {e: f"g{i % 3}" for i, e in enumerate(ids) if i < 18}  # the last six are in no group
    moved, rows = [], []
    for a in range(12):
        for g in rng.sample(["g0", "g1", "g2"], a % 4):
            inside = sorted((e for e in home if home[e] == g), key=lambda e: -value[e])
            moved.append((f"a{a}", g, g, "utilization_pct", rng.choice([-100.0, -15.0, 3.0, 25.0]), inside[:a % 3]))
        apart = [e for m in moved if m[0] == f"a{a}" for e in m[5]]
        free = [e for e in ids if not any(m[0] == f"a{a}" and m[1] == home.get(e) for m in moved)]
        rows += [(f"a{a}", e, "utilization_pct", value[e], -9.0, value[e] - 9.0) for e in apart[::2] + sorted(free, key=lambda e: -value[e])[:a % 5]]
    links = spark.createDataFrame([(e,) for e in ids], "link_id string")
    effect = W.Effect(
        spark.createDataFrame(rows, "action_id string, entity_id string, metric string, current double, delta double, predicted double"),
        spark.createDataFrame(moved, "action_id string, hub string, group string, metric string, delta double, apart array<string>"),
        spark.createDataFrame([(g, g, e, e, "utilization_pct", value[e]) for e, g in home.items()], "hub string, group string, leaf string, entity_id string, metric string, value double"))
    want = {}
    for a in [f"a{i}" for i in range(12)]:
        after = dict(value)
        for _, _, g, _, delta, apart in (m for m in moved if m[0] == a):
            after.update({e: max(0.0, value[e] + delta) for e in home if home[e] == g and e not in apart})
        after.update({r[1]: r[5] for r in rows if r[0] == a})
        want[a] = max(after.values())
    actions = spark.createDataFrame([(a, "rate_limit", None, None, {}) for a in want], ACTION)
    monkeypatch.setattr(W.Effect, "all_rows", lambda self: pytest.fail("every row was written"))
    got = S.worst_link(S.SafetyInput(actions, state_of(spark, {(e, "utilization_pct"): v for e, v in value.items()}), effect, None, links)).collect()
    assert {r["action_id"]: r["worst_util"] for r in got} == want


HYPOTHESIS = ("incident_id string, hypothesis_id string, description string, root_cause string, confidence double, evidence array<string>, "
              "affected_nodes array<string>, affected_links array<string>, recommended_actions array<string>")


def test_candidates_and_policy(spark, links):
    rows = spark.createDataFrame([
        ("i", "h1", "High utilization on CR1-CR2", "CR1-CR2_utilization", 0.9, ["x"], [], ["CR1-CR2"], []),
        ("i", "h2", "Two downstream anomalies", "AGG1_cpu", 0.5, [], ["AGG1"], [], []),
    ], HYPOTHESIS)
    out = W.candidates(rows, links)
    kinds = {}
    for r in out.collect():
        kinds.setdefault(r["hypothesis_id"], []).append(r["action_type"])
    assert kinds == {"h1": ["reroute", "rate_limit"], "h2": ["reroute", "escalate"]}
    words = {r["hypothesis_id"]: r["hypothesis_class"] for r in W.candidates(rows, links, whole_words=True).collect()}
    assert words["h2"] == "congestion"
    first = out.where("hypothesis_id = 'h1' AND action_type = 'reroute'").first()
    assert first["parameters"]["to_link"] == "AGG1-CR1" or first["parameters"]["to_link"].startswith(("AGG", "CR1"))
    assert first["risk_level"] == pytest.approx(0.55 + 0.1 * 0.2 + 0.7 * 0.25)
    decided = {r["action_id"]: (r["decided_type"], r["requires_approval"]) for r in W.policy(out).collect()}
    assert decided["h1/reroute"] == ("reroute", True) and decided["h2/escalate"] == ("create_ticket", False)


def results(spark, rows):
    return spark.createDataFrame(rows, "action_id string, key string, pre double, post double")


def test_outcome_labels(spark):
    rows = results(spark, [
        ("good", "l.latency_ms", 150.0, 50.0), ("mixed", "l.latency_ms", 150.0, 50.0), ("mixed", "l.utilization_pct", 50.0, 50.0),
        ("bad", "l.latency_ms", 150.0, 50.0), ("bad", "n.cpu_pct", 50.0, 61.0), ("slow", "l.throughput_gbps", 10.0, 7.9),
        ("none", "n.cpu_pct", 50.0, 50.0), ("gone", "l.latency_ms", 150.0, None),
    ])
    out = {r["action_id"]: r["outcome"] for r in O.label_outcomes(rows, "action_id").collect()}
    assert out == {"good": "effective", "mixed": "partially_effective", "bad": "harmful", "slow": "harmful", "none": "ineffective", "gone": "ineffective"}


def test_rollback_monitor(spark, long_rows):
    actions = spark.createDataFrame([("a", minute(0), "L-M", "latency_ms", 10.0), ("b", minute(5), "L-M", "latency_ms", 20.0)],
                                    "action_id string, ts timestamp, entity_id string, metric string, pre double")
    long = long_rows({("L-M", "link", "latency_ms"): [50, 11, 12, 12.1, 13] + [10] * 5 + [12.5, 99]})
    out = {r["action_id"]: (r["breach_ts"].minute, r["breaches"]) for r in O.rollback_breaches(actions, long).collect()}
    assert out == {"a": (3, 3), "b": (11, 1)}


def test_retrain_signal_fires_per_hundred(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([60, 30, 10, 250, 10, 40])], "cycle bigint, n bigint")
    assert [r["cycle"] for r in O.retrain_signals(counts, "cycle", "n").orderBy("cycle").collect()] == [2, 3, 5]

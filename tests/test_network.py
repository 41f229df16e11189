import pytest
from pyspark.sql import functions as F

from tests.conftest import minute
from tickwarden.operators import causal as C
from tickwarden.operators import paths as P
from tickwarden.operators import topology as TP


@pytest.fixture(scope="module")
def graph(nodes, links):
    return C.structural_graph(nodes, links).cut()


def test_structural_edges_of_the_sample(graph):
    assert graph.cliques is None
    assert graph.edges.count() == 172
    assert C.graph_summary(graph.edges).first()["num_nodes"] == 103


def edges(spark, rows):
    return C.CausalGraph(spark.createDataFrame(rows, "src string, dst string, strength double").withColumn("edge_type", F.lit("structural")))


def test_clique_form_gives_the_same_search_and_propagation(spark, nodes, links, graph):
    hubs = C.structural_graph(nodes, links, max_degree=0)
    assert hubs.cliques is not None and hubs.edges.count() < graph.edges.count()
    seeds = spark.createDataFrame([("i", "AGG1-EDGE1_latency"), ("i", "CR1_latency"), ("j", "AGG3-EDGE3_utilization")], "incident_id string, seed string")
    show = lambda g: {tuple(r) for r in C.upstream(g, seeds, ["incident_id"]).select("incident_id", "seed", "node", "hops", F.round("strength", 9)).collect()}
    assert show(graph) == show(hubs)
    deltas = spark.createDataFrame([("a", "CR1-CR2_utilization", -10.0), ("a", "AGG1-CR1_utilization", 10.0), ("b", "AGG1-EDGE1_utilization", 3.0)],
                                   "action_id string, variable string, delta double")
    total = lambda g: {(r["action_id"], r["variable"]): (round(r["delta"], 9), r["hops"]) for r in C.propagate(g, deltas).collect()}
    assert total(graph) == total(hubs)


def test_propagation_is_linear_and_expands_once(spark):
    g = edges(spark, [("a", "b", 0.5), ("b", "c", 0.5), ("c", "a", 0.5), ("a", "c", 0.1)])
    run = lambda x: {r["variable"]: r["delta"] for r in C.propagate(g, spark.createDataFrame([("k", "a", x)], "action_id string, variable string, delta double")).collect()}
    one, two = run(1.0), run(2.0)
    # a -> b .5, a -> c .1; then b -> c .25 and c (carrying .1) -> a .05; nothing is expanded twice.
    assert one == pytest.approx({"a": 1.05, "b": 0.5, "c": 0.35})
    assert two == pytest.approx({k: 2 * v for k, v in one.items()})


def test_upstream_tie_rule(spark):
    g = edges(spark, [("x", "s", 0.5), ("y", "s", 0.8), ("r", "x", 0.8), ("r", "y", 0.5), ("q", "r", 0.9), ("s", "q", 0.9), ("deep", "q", 0.2)])
    rows = {r["node"]: r for r in C.upstream(g, spark.createDataFrame([("i", "s")], "incident_id string, seed string"), max_hops=3).collect()}
    assert rows["r"]["hops"] == 2 and rows["r"]["path"] == "r>x>s" and rows["r"]["strength"] == pytest.approx(0.4)
    assert rows["q"]["hops"] == 3 and "deep" not in rows and "s" not in rows


def anomalies(spark, rows):
    return spark.createDataFrame(rows, "incident_id string, ts timestamp, entity_id string, metric string, observed double, expected double, severity string, confidence double, seq bigint")


def test_root_cause_modes(spark, graph):
    rows = anomalies(spark, [
        ("i", minute(0), "AGG1-EDGE1", "utilization_pct", 97.0, 85.0, "high", 0.8, 0),
        ("i", minute(1), "AGG1-EDGE1", "latency_ms", 30.0, 2.5, "critical", 0.7, 1),
        ("i", minute(1), "AGG1-EDGE1", "packet_loss_pct", 4.0, 1.0, "critical", 0.7, 2),
        ("lonely", minute(1), "NOWHERE", "cpu_pct", 99.0, 90.0, "high", 0.7, 3),
    ])
    live = {(r["incident_id"], r["rank"]): r for r in C.root_causes(rows, graph).collect()}
    assert live[("i", 1)]["root_cause"] == "AGG1-EDGE1_utilization"
    assert live[("i", 1)]["affected_links"] == ["AGG1-EDGE1"] and len(live[("i", 1)]["evidence"]) == 2
    assert live[("lonely", 1)]["root_cause"] == "NOWHERE_cpu" and live[("lonely", 1)]["confidence"] == 0.42
    strict = C.root_causes(rows, graph, allow_observed_roots=False).where("incident_id = 'i'").collect()
    assert all(r["root_cause"] != "AGG1-EDGE1_utilization" for r in strict) and len(strict) == 5
    assert C.top_hypotheses(C.root_causes(rows, graph)).where("incident_id = 'i'").count() == 3


def test_leaves_of_a_hub_share_one_candidate(spark):
    ends = [("H", f"U{i}") for i in range(12)] + [("H", "K"), ("K", "V0"), ("K", "V1"), ("K", "V2"), ("K", "V3")]
    links = spark.createDataFrame([("-".join(sorted(e)), *e, 1.0, 1.0) for e in ends], "link_id string, source string, target string, capacity_gbps double, latency_baseline_ms double")
    nodes = spark.createDataFrame([(n, "edge") for n in sorted({n for e in ends for n in e})], "node_id string, node_type string")
    rows = anomalies(spark, [
        (i, minute(t), f"H-U{u}", m, 9.0, 1.0, "high", 0.7, t * 100 + u)
        for i, t, u, m in [("i", 0, 0, "latency_ms"), ("i", 1, 1, "utilization_pct"), ("i", 2, 3, "packet_loss_pct"), ("j", 0, 2, "utilization_pct"), ("j", 3, 2, "latency_ms")]
    ] + [("j", minute(1), "K-V0", "latency_ms", 9.0, 1.0, "high", 0.7, 7)])
    whole, hubs = (C.structural_graph(nodes, links, max_degree=n) for n in (100, 2))
    seen = C.observed_variables(rows).cache()
    reach = C.reachable(seen, hubs)
    every = C.reachable(seen, whole).rows.count()
    assert reach.rows.count() < every and reach.leaves.count() == 16
    show = lambda g: sorted(str(r) for r in C.root_causes(rows, g, top=14).collect())
    assert show(whole) == show(hubs)


def test_siblings_that_share_both_ends_come_once(spark):
    links = spark.createDataFrame([("p", "A", "B"), ("q", "A", "B"), ("q", "A", "B"), ("r", "B", "C"), ("s", "D", "D")], "link_id string, source string, target string")
    rows = TP.sibling_links(spark.createDataFrame([("p",), ("p",), ("s",)], "link_id string"), links)
    assert sorted(tuple(r) for r in rows.collect()) == [("p", "q"), ("p", "r")]
    assert "Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_lagged_edges(spark):
    rows = [("lead", t, float((t * 7) % 11)) for t in range(60)] + [("follow", t + 2, float((t * 7) % 11) * 2 + 1) for t in range(60)] + [("flat", t, 1.0) for t in range(60)]
    grid = spark.createDataFrame(rows, "variable string, t bigint, value double")
    pairs = spark.createDataFrame([(a, b) for a in ("lead", "follow", "flat") for b in ("lead", "follow", "flat") if a != b], "src string, dst string")
    found = {(r["src"], r["dst"]): r for r in C.lagged_edges(grid, pairs).collect()}
    assert found[("lead", "follow")]["strength"] == 1.0
    assert all("flat" not in k for k in found)
    assert C.best_lag(C.lagged_stats(grid, pairs)).where("src = 'lead' AND dst = 'follow'").first()["lag"] == 2


def test_union_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "src string, dst string, strength double")
    out = {r["src"]: (r["strength"], r["edge_type"]) for r in C.union_edges(make([("a", "x", 0.5), ("b", "x", 0.5), ("c", "x", 0.5)]), make([("a", "x", 0.7), ("b", "x", 0.3), ("d", "x", 0.9)])).collect()}
    assert out == {"a": (0.7, "both"), "b": (0.5, "structural"), "c": (0.5, "structural"), "d": (0.9, "learned")}


def test_clique_pairs_are_written_once_and_not_shuffled(spark, nodes, links, graph):
    hubs = C.structural_graph(nodes, links, max_degree=2).cut()
    show = lambda rows: sorted(tuple(r) for r in rows.select("src", "dst", "strength", "edge_type").collect())
    assert hubs.cliques is not None and show(hubs.all_edges()) == show(graph.all_edges())
    twice = C.CausalGraph(hubs.edges, hubs.cliques.unionByName(hubs.cliques))
    assert show(twice.all_edges()) == show(graph.all_edges())
    # Two members that share both their hubs are one pair; blocks of a hub are met by all its members.
    cliques = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("b", "y"), ("c", "y"), ("d", "y")], "member string, hub string")
    pairs = sorted(tuple(r) for r in C.clique_pairs(cliques, 3).collect())
    assert pairs == sorted((p, q) for p in "abcd" for q in "abcd" if p != q)
    plan = C.clique_pairs(cliques, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_pairs_of_busy_keys_are_cut_into_a_grid(spark):
    left = spark.createDataFrame([(k, i) for k, n in (("x", 90), ("y", 3), ("z", 1), ("only", 4), (None, 5)) for i in range(n)] + [("x", 0)], "key string, a int")
    right = spark.createDataFrame([(k, i) for k, n in (("x", 70), ("y", 200), ("z", 1), (None, 2)) for i in range(n)] + [("y", 7)], "key string, b int")
    want = sorted(map(tuple, left.join(right, "key").collect()))
    for most in (300, 10**6):
        assert sorted(map(tuple, TP.pairs_at(left, right, "key", most).select("key", "a", "b").collect())) == want
    # Rows repeated for 467 blocks of 21,600 rows that meet as many: 22 times each, not 467 times those of one side.
    sizes = spark.createDataFrame([(21_600, 21_600), (40_000, 100), (1, 5_000_000), (3, 2)], "_l long, _r long")
    cuts = {r["_l"]: r for r in TP.grid(sizes, 1_000_000).collect()}
    assert (cuts[21_600]["_ls"], cuts[21_600]["_rs"]) == (22, 22) and (cuts[1]["_ls"], cuts[1]["_rs"]) == (1, 5) and (cuts[3]["_ls"], cuts[3]["_rs"]) == (1, 1)
    for r in cuts.values():
        assert r["_l"] * r["_r"] <= 1.3e6 * r["_ls"] * r["_rs"]


def test_union_graph_is_the_union_of_edges(spark, nodes, links, graph):
    hubs = C.structural_graph(nodes, links, max_degree=2)
    learned = spark.createDataFrame([
        ("CR1-CR2_utilization", "AGG1-CR1_utilization", 0.7), ("AGG1-CR1_utilization", "AGG2-CR1_utilization", 0.3),
        ("CR1_cpu", "CR1_temperature", 0.9), ("CR1_memory", "CR2_memory", 0.8),
    ], "src string, dst string, strength double")
    show = lambda rows: sorted(tuple(r) for r in rows.select("src", "dst", "strength", "edge_type").collect())
    assert show(C.union_graph(hubs, learned).all_edges()) == show(C.union_edges(graph.edges, learned))


def brute_paths(links, source, target, most):
    near = {}
    for r in links:
        near.setdefault(r["source"], set()).add(r["target"])
        near.setdefault(r["target"], set()).add(r["source"])
    out, stack = [], [[source]]
    while stack:
        path = stack.pop()
        if path[-1] == target:
            out.append(path)
            continue
        if len(path) <= most:
            stack += [path + [n] for n in near[path[-1]] if n not in path]
    return out


def test_paths_against_brute_force(spark, links):
    rows = links.collect()
    wanted = [("EDGE1", "EDGE4"), ("CR1", "CR2"), ("PEER1", "AGG1"), ("EDGE3", "AGG3")]
    pairs = spark.createDataFrame(wanted, "source string, target string")
    counts = {(r["source"], r["target"]): r["paths"] for r in P.path_counts(links, pairs, 6).collect()}
    assert counts == {p: len(brute_paths(rows, *p, 6)) for p in wanted}
    short = {(r["source"], r["target"]): r["path"] for r in P.shortest_paths(links, pairs).collect()}
    for p in wanted:
        least = min(brute_paths(rows, *p, 6), key=lambda q: (len(q), ">".join(q)))
        assert short[p] == ">".join(least)


def test_neighbourhood(spark, nodes, links):
    util = spark.createDataFrame([("CR1-CR2", 40.0), ("AGG1-CR1", 80.0)], "link_id string, value double")
    means = {r["node_id"]: r["mean_utilization"] for r in TP.neighbor_mean(links, nodes, util).collect()}
    assert means["CR1"] == 60.0 and means["EDGE4"] == 50.0
    counts = {r["link_id"]: r["co_located"] for r in TP.colocation_counts(links).collect()}
    near = {r["target_link"]: r["n"] for r in TP.sibling_links(links.select("link_id"), links).groupBy("target_link").agg(F.count("*").alias("n")).collect()}
    assert counts == near
    load = {r["link_id"]: r for r in TP.sibling_load(links, util).collect()}
    assert load["AGG1-CR1"]["siblings"] == near["AGG1-CR1"] and load["AGG1-CR1"]["mean_sibling_utilization"] == 40.0
    alternates = {r["link_id"]: r["alternate"] for r in TP.alternate_link(links).collect()}
    assert alternates["AGG1-AGG2"] == "AGG1-CR1" and alternates["AGG1-CR1"] == "AGG1-AGG2"
    total = TP.totals(nodes, links).first()
    assert (total["total_nodes"], total["total_links"], total["total_customers"]) == (12, 15, 455000)
    ends = {r["link_id"]: r["downstream"] for r in TP.directed_links(links, nodes).collect()}
    assert ends["CR1-PEER1"] == "CR1" and ends["AGG1-CR1"] == "AGG1" and ends["AGG1-PEER1"] == "AGG1"


def test_customer_impact_counts_a_node_once(spark, nodes):
    rows = spark.createDataFrame([("h", "EDGE1"), ("h", "AGG1-EDGE1"), ("g", "CR1-CR2")], "key string, entity_id string")
    out = {r["key"]: r for r in TP.customer_impact(rows, nodes, "key").collect()}
    assert out["h"]["customers"] == 120000 and out["h"]["impact"] == pytest.approx(120000 / 455000) and out["g"]["customers"] == 0
    regions = TP.target_regions(rows, nodes, "key")
    actions = spark.createDataFrame([("h",), ("g",)], "key string")
    assert [r["key"] for r in TP.not_blocked(actions, regions, ["west"], "key").collect()] == ["h"]


def test_second_paths_against_search(spark):
    import random

    from tickwarden.operators.paths import second_paths

    rnd = random.Random(4)
    edges = sorted({tuple(sorted(rnd.sample(range(14), 2))) for _ in range(17)}) + [(20 + i, 20 + (i + 1) % 9) for i in range(9)] + [(30, 31)]
    links = spark.createDataFrame([(f"{a}-{b}", str(a), str(b)) for a, b in edges], "link_id string, source string, target string")

    def around(link, limit):
        a, b = link
        seen, front = {a}, {a}
        for _ in range(limit):
            front = {y for x in front for p in edges if p != link and x in p for y in p} - seen
            seen |= front
        return b in seen

    for limit, kinds in ((2, 1), (6, 2), (8, 2)):
        got = {r["link_id"]: r["second"] for r in second_paths(links, limit).collect()}
        assert got == {f"{a}-{b}": around((a, b), limit) for a, b in edges} and len(set(got.values())) == kinds

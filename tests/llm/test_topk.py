from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwarden.llm import topk

SCHEMA = "vec_id long, embedding array<float>, norm string, id int, score int"


def brute(rows, k, step):
    kept = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(64 * float(np.float32(x))) for x in v]
        kept[i] = min(kept.get(i, q), q)
    width = max(map(len, kept.values()), default=0)
    kept = {i: q + [0] * (width - len(q)) for i, q in kept.items()}
    out = []
    for i, q in kept.items():
        if i % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in kept.items() if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def rows(n=700, d=8, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        scale = rnd.choice([0.1, 1.0, 1.0, 4.0])
        out.append((i, [scale * rnd.gauss(0, 1) for _ in range(d)]))
    out += [(n, None), (n + 1, [1.0, None] + [0.0] * (d - 2)), (n + 2, [float("nan")] * d), (n + 3, [float("inf")] * d), (None, [1.0] * d)]
    out += [(3, [0.0] * d), (20, [9.0] * d), (2000, []), (2020, [0.5, -0.5])] + [(3000 + i, [1.0] + [0.0] * (d - 1)) for i in range(60)]
    return out


@pytest.mark.parametrize("bucket,seeds,queries", [(4096, 4096, 512), (64, 64, 16), (50, 5, 7)])
def test_matches_brute_force(spark, monkeypatch, bucket, seeds, queries):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "SEEDS", seeds)
    monkeypatch.setattr(topk, "QUERIES", queries)
    data = rows()
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in data], SCHEMA)
    got = sorted(map(tuple, topk.top_k(df, F.col("id") % 20 == 0).collect()))
    assert got == brute(data, 20, 20)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0], "", 0, 0), (1, [2.0], "", 0, 0), (2, [2.0], "", 0, 0)], SCHEMA)
    assert sorted(map(tuple, topk.top_k(df, F.col("id") == 0).collect())) == [(0, 1, 1, 64 * 128), (0, 2, 2, 64 * 128)]
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id = 0"), F.col("id") % 20 == 0).count() == 0


def test_a_block_gives_the_same_by_length_by_coordinate_and_in_full():
    rnd = np.random.default_rng(3)
    v = rnd.integers(-60, 60, (300, 6))
    q = rnd.integers(-60, 60, (20, 6))
    ids, q_ids = np.arange(300), np.arange(1000, 1020)
    full = topk.products(q, v)
    for share in (0.0, 0.3, 0.9, 1.1):
        bounds = share * np.sqrt((q**2).sum(1)) * np.sqrt((v**2).sum(1)).max()
        for i, got, scores in topk.search_block(q_ids, q, bounds, ids, v, 10):
            want = [j for j in np.lexsort((ids, -full[i])) if full[i][j] >= bounds[i]][:10]
            assert got.tolist() == want and scores.tolist() == full[i][want].tolist()


def test_large_components_stay_exact():
    a = np.array([[2**40 + 1, 3]], dtype=np.int64)
    b = np.array([[2**20 + 1, 5]], dtype=np.int64)
    assert topk.products(a, b)[0, 0] == (2**40 + 1) * (2**20 + 1) + 15


def test_many_query_blocks_meet_vector_blocks_by_equality(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "BUCKET", 40)
    rnd = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rnd.normal(size=6) * rnd.choice([0.05, 1, 8])]) for i in range(4000)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") >= 0, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    v = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64)
    scores = v @ v.T
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for i in range(0, 4000, 37):
        best = sorted((-int(s), j) for j, s in enumerate(scores[i]) if j != i)[:3]
        assert got[i] == [(j, -s) for s, j in best]
    assert len(got) == 4000


def test_the_longest_vectors_are_merged_outside_the_driver(spark, monkeypatch):
    """Eight tasks offer about 0.2 MB each; what the driver may receive is less than all of them and more than one."""
    monkeypatch.setattr(topk, "SEEDS", 400)
    rnd = np.random.default_rng(8)
    v = np.floor(64 * rnd.normal(size=(4000, 64))).astype(np.int64)
    v[::2] = v[0]  # as long as each other, so that no length parts them
    conf, limit = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    rows = spark.createDataFrame([(i, (x / 64).tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        conf.set(limit, "1m")
        held = topk.cut(topk.quantised(rows, "vec_id", "embedding"))
        assert held.rdd.getNumPartitions() == 8
        got = [r["id"] for r in topk.longest(held, 400).collect()]
        found = topk.top_k(rows, F.col("id") < 40, 3).orderBy("query_id", "rank").collect()
    finally:
        conf.remove(limit)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    norms = (v**2).sum(1)
    assert sorted(got) == sorted(np.lexsort((np.arange(4000), -norms))[:400].tolist())
    scores = v @ v.T
    for i in range(40):
        best = sorted((-int(s), j) for j, s in enumerate(scores[i]) if j != i)[:3]
        assert [(r["vec_id"], r["score"]) for r in found if r["query_id"] == i] == [(j, -s) for s, j in best]

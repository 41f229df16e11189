from __future__ import annotations

import random

from pyspark.sql import functions as F

from tickwarden.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies int"


def shares(sizes):
    """Targets by sharing out again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not full:
            return {**target, **{s: level * weight[s] for s in free}}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def data():
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        source = rnd.choice(["hot"] * 12 + ["b", "a", None, "é", "Z", "tiny"][: 6 if i % 9 == 0 else 4])
        n = 7 if rnd.random() < 0.4 else rnd.randrange(0, 60)
        rows.append((i if rnd.random() < 0.97 else None, None if n == 0 else " ".join(["w"] * n), source, "x", 9))
    return rows + [rows[0]] * 3 + [(5000, "  \n", "no words", "", 1)]


def test_targets_and_taken_words(spark):
    rows = data()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).select("row.source", F.col("size").alias("n"), "source_size", "target", F.col("copies").alias("c")).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = shares(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["c"] <= 3
        taken[r["source"]] += r["c"] * r["n"]
    for s, target in want.items():
        assert abs(taken[s] - target) <= 60 + 1e-6
    again = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).select("row.doc_id", "size", "copies")
    first = mixing.mix(spark.createDataFrame(rows, SCHEMA)).select("row.doc_id", "size", "copies")
    assert again.exceptAll(first).count() == 0 and first.exceptAll(again).count() == 0


def test_take_repeats_rows_and_keeps_columns(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    mixed = mixing.mix(df)
    out = mixing.take(mixed)
    assert out.columns == df.columns
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.take(mixing.mix(df.limit(0))).count() == 0


def test_one_source_is_taken_whole(spark):
    df = spark.createDataFrame([(i, "a b c", None, "", 0) for i in range(10)], SCHEMA)
    assert {r["copies"] for r in mixing.mix(df).collect()} == {1}

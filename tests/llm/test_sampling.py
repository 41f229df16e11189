from __future__ import annotations

from pyspark.sql import functions as F

from tickwarden.llm import sampling

LABELS = "key long, label int"


def big(spark):
    """One label of 6,000 rows among others, some texts null, empty, long or equal."""
    texts = spark.range(7000).select(F.col("id").alias("key"), F.expr(
        "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN '' WHEN id % 17 = 0 THEN repeat('x', 60) WHEN id % 19 = 0 THEN 'same' ELSE concat('t', id) END").alias("text"))
    return texts, spark.range(7000).select(F.col("id").alias("key"), F.when(F.col("id") < 6000, 0).when(F.col("id") < 6990, 1).otherwise(F.col("id").cast("int")).alias("label"))


def test_the_cut_by_hash_changes_nothing(spark, monkeypatch):
    texts, labels = big(spark)
    for pieces in (False, True):
        got = sampling.sample(texts, labels, 40, 10_000, 50, pieces)
        monkeypatch.setattr(sampling, "SPARE", 10_000)
        whole = sampling.sample(texts, labels, 40, 10_000, 50, pieces)
        monkeypatch.undo()
        assert got == whole and len([1 for y, _, _ in got if y == 0]) == 40
        assert sampling.sample(texts.join(labels, "key"), None, 40, 10_000, 50, pieces) == got
    assert {len(t) for _, _, t in got if t.startswith("x")} == {50}


def test_a_label_whose_low_hashes_have_no_text_is_ranked_in_full(spark):
    labels = spark.range(20000).select(F.col("id").alias("key"), F.lit(1).alias("label"))
    at = F.xxhash64(F.lit(sampling.SALT), F.col("key").cast("string"))
    texts = labels.select("key", F.when(at > 0, F.concat(F.lit("t"), "key")).alias("text"))
    got = sampling.sample(texts, labels, 30, 10_000, 50)
    want = [r["key"] for r in texts.filter("text is not null").orderBy(at).limit(30).collect()]
    assert sorted(k for _, k, _ in got) == sorted(want)


def test_no_labels_and_no_rows(spark):
    texts, labels = big(spark)
    assert sampling.sample(texts, labels.limit(0), 5, 100, 50) == []
    assert sampling.sample(texts.limit(0), labels, 5, 100, 50) == []
    assert sampling.sample(texts, labels.select("key", F.lit(None).cast("int").alias("label")), 5, 100, 50) == []

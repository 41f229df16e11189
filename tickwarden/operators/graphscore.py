"""Scores of nodes in their surroundings: rule shares and a learned score on neighbour-smoothed features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.functions.severity import predicted_severity
from tickwarden.operators.topology import both_directions
from tickwarden.session import cut

# Limits of the rule score.
RULE_LIMITS = {"utilization_pct": 85.0, "latency_ms": 50.0, "packet_loss_pct": 1.0, "buffer_drops": 100.0}
FLAG_AT = 0.6


def violation_scores(rows: DataFrame) -> DataFrame:
    """Share of the limits a wide row exceeds; anomalous from 0.6 on."""
    hits = sum(
        (F.when(F.coalesce(F.col(m), F.lit(0.0)) > limit, 1).otherwise(0) for m, limit in RULE_LIMITS.items() if m in rows.columns),
        F.lit(0),
    )
    score = F.least(F.lit(1.0), hits / float(len(RULE_LIMITS)))
    return rows.withColumn("score", score).withColumn("anomalous", F.col("score") >= FLAG_AT)


def smoothed(features: DataFrame, links: DataFrame, columns: Sequence[str], time: str, hops: int = 2) -> DataFrame:
    """Average each node's features over itself and its neighbours, normalised by degree, `hops` times.

    A hop is a join with the arcs and a sum per (time, node); sums combine before the shuffle.
    """
    links = cut(links.select("source", "target"))
    arcs = both_directions(links).select(F.col("source").alias("entity_id"), F.col("target").alias("to"))
    loops = links.select(F.explode(F.array("source", "target")).alias("entity_id")).distinct().withColumn("to", F.col("entity_id"))
    arcs = arcs.unionByName(loops)
    size = arcs.groupBy("entity_id").agg(F.count("*").alias("_d"))
    arcs = arcs.join(size, "entity_id").join(size.select(F.col("entity_id").alias("to"), F.col("_d").alias("_e")), "to")
    arcs = cut(arcs.select("entity_id", "to", (1.0 / F.sqrt(F.col("_d") * F.col("_e"))).alias("_w")))
    rows = features.select(time, "entity_id", *columns)
    for _ in range(hops):
        spread = rows.join(arcs, "entity_id")
        rows = spread.groupBy(time, F.col("to").alias("entity_id")).agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in columns])
    return rows


def _inputs(features: DataFrame, links: DataFrame, columns: Sequence[str], time: str) -> DataFrame:
    near = smoothed(features, links, columns, time).withColumnsRenamed({c: "near_" + c for c in columns})
    rows = features.join(near, [time, "entity_id"], "left").fillna(0.0, ["near_" + c for c in columns])
    return VectorAssembler(inputCols=[*columns, *["near_" + c for c in columns]], outputCol="_x").transform(rows)


def fit_graph_score(features: DataFrame, links: DataFrame, columns: Sequence[str], time: str) -> LogisticRegressionModel:
    """Learn the pseudo-label from a node's own and its neighbours' features."""
    learner = LogisticRegression(featuresCol="_x", labelCol="label", maxIter=20, regParam=0.01)
    rows = _inputs(features, links, columns, time).select(F.array(*[F.col(c) for c in columns], *[F.col("near_" + c) for c in columns]).alias("_a"), "label")
    return learner.fit(cut(rows).select(array_to_vector("_a").alias("_x"), "label"))


def graph_scores(model: LogisticRegressionModel, features: DataFrame, links: DataFrame, columns: Sequence[str], time: str) -> DataFrame:
    scored = model.transform(_inputs(features, links, columns, time))
    return scored.select(time, "entity_id", "label", vector_to_array("probability")[1].alias("score"))


def graph_anomalies(scores: DataFrame, time: str) -> DataFrame:
    """Anomaly rows from 0.6 on."""
    hit = scores.where(F.col("score") >= FLAG_AT)
    return hit.select(
        F.col(time), "entity_id", F.lit("graph_anomaly_score").alias("metric"), F.round("score", 6).alias("observed"),
        F.lit(0.5).alias("expected"), predicted_severity(F.col("score") * 1.5).alias("severity"),
        F.round(F.least("score", F.lit(0.95)), 4).alias("confidence"), F.lit("graph").alias("detector"),
    )

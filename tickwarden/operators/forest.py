"""Isolation forest per metric. A one-dimensional forest is a step function, so scoring is a sorted lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.functions.severity import clamp, isolation_severity
from tickwarden.operators.detect import anomaly
from tickwarden.operators.series import best_rows

SUBSAMPLE = 256


def _average_depth(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    expected = 2.0 * (np.log(safe - 1.0 + (safe == 2)) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, expected))


def _tree_steps(values: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Grow one tree on sorted values; return its cut points and the path length of each interval."""
    limit = int(np.ceil(np.log2(max(len(values), 2))))
    cuts, depths, stack = [], [], [(0, len(values), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        n = hi - lo
        if n <= 1 or depth >= limit or values[lo] == values[hi - 1]:
            depths.append(depth + float(_average_depth(n)))
            continue
        cut = rng.uniform(values[lo], values[hi - 1])
        mid = lo + int(np.searchsorted(values[lo:hi], cut, side="right"))
        mid = min(max(mid, lo + 1), hi - 1)
        # Left intervals are popped first, so cuts and depths come out in value order.
        stack.append((mid, hi, depth + 1))
        stack.append((lo, mid, depth + 1))
        cuts.append(cut)
    return np.sort(np.array(cuts)), np.array(depths)


def _fit(trees: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        metric = pdf["metric"].iloc[0]
        pool = np.sort(pdf["value"].to_numpy(dtype=float))
        size = min(SUBSAMPLE, len(pool))
        rng = np.random.default_rng(seed)
        grown = [_tree_steps(np.sort(rng.choice(pool, size, replace=False)), rng) for _ in range(trees)]
        edges = np.unique(np.concatenate([c for c, _ in grown])) if grown else np.array([])
        # A value v falls into interval searchsorted(cuts, v, side="left") of every tree.
        probe = np.append(edges, np.inf)
        depth = np.mean([d[np.searchsorted(c, probe, side="left")] for c, d in grown], axis=0)
        score = -np.power(2.0, -depth / max(float(_average_depth(size)), 1e-9))
        return pd.DataFrame(
            {"metric": [metric], "edges": [edges.tolist()], "scores": [score.tolist()], "median": [float(np.median(pool))]}
        )

    return run


def sample_values(long: DataFrame, per_metric: int, seed: int) -> DataFrame:
    """Up to `per_metric` values per metric, chosen by hash so that partitioning does not matter.

    Metrics much larger than the sample are thinned by a hash cut before the ranking.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), "metric", "entity_id", "ts", "seq"), F.lit(1 << 40))
    rows = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    sizes = rows.groupBy("metric").agg(F.count("*").alias("_n"))
    keep = F.least(F.lit(1.0), F.lit(4.0 * per_metric) / F.col("_n")) * float(1 << 40)
    rows = rows.join(sizes, "metric").withColumn("_d", draw).where(F.col("_d") <= keep)
    return best_rows(rows, ["metric"], [F.col("_d"), F.col("seq")], per_metric, "_r").select("metric", "value")


def fit_forest(long: DataFrame, trees: int = 100, seed: int = 42, min_points: int = 10) -> DataFrame:
    """Step table per metric: `edges`, `scores` (one more than edges) and the `median` of all training values.

    Each tree is grown on SUBSAMPLE values, as the method has it; the trees share a pool of trees * SUBSAMPLE values a
    metric, drawn evenly from all rows.
    """
    sample = sample_values(long, SUBSAMPLE * trees, seed)
    enough = sample.groupBy("metric").agg(F.count("*").alias("n")).where(F.col("n") >= min_points)
    schema = "metric string, edges array<double>, scores array<double>, median double"
    grown = sample.join(enough, "metric", "left_semi").groupBy("metric").applyInPandas(_fit(trees, seed), schema)
    usable = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    medians = usable.groupBy("metric").agg(F.percentile_approx("value", 0.5, 10_000).alias("median"))
    return grown.drop("median").join(medians, "metric")


def score_forest(long: DataFrame, steps: DataFrame) -> DataFrame:
    """Add `score` (lower is more isolated). The model is one step table per metric name, a fixed small set."""
    model = {r["metric"]: (np.array(r["edges"]), np.array(r["scores"])) for r in steps.collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = np.full(len(pdf), np.nan)
            for metric, index in pdf.groupby("metric").indices.items():
                edges, scores = model[metric]
                score[index] = scores[np.searchsorted(edges, pdf["value"].to_numpy()[index], side="left")]
            yield pdf.assign(score=score)

    schema = ", ".join(f"`{c}` {t}" for c, t in long.dtypes) + ", score double"
    known = long.where(F.col("metric").isin(*model) & F.col("value").isNotNull())
    return known.mapInPandas(run, schema)


def forest_offsets(scored: DataFrame, contamination: float = 0.05) -> DataFrame:
    return scored.groupBy("metric").agg(F.percentile_approx("score", contamination, 10_000).alias("offset"))


def forest_hits(scored: DataFrame, offsets: DataFrame, medians: DataFrame) -> DataFrame:
    """Rows scoring under the metric's offset. `expected` is the training median."""
    rows = scored.join(offsets, "metric").join(medians, "metric")
    rows = rows.withColumn("decision", F.col("score") - F.col("offset")).where(F.col("decision") < 0)
    return anomaly(
        rows, F.col("value"), F.col("median"), isolation_severity(F.col("decision")),
        clamp(0.5 - F.col("decision"), 0.5, 0.95), "isolation_forest",
    )


def forest_detector(steps: DataFrame, offsets: DataFrame):
    medians = steps.select("metric", "median")
    return lambda long: forest_hits(score_forest(long, steps), offsets, medians)

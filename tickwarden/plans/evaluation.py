"""Offline evaluation: train, observe, score detection, root causes and decisions, one report row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.operators import evaluation as E
from tickwarden.operators.causal import structural_graph
from tickwarden.operators.intervals import label_times
from tickwarden.plans import observer as O
from tickwarden.session import cut


@dataclass
class Evaluation:
    report: DataFrame
    emitted: DataFrame
    per_scenario: DataFrame
    root_causes: DataFrame
    decisions: DataFrame


def evaluate(
    train: DataFrame, test: DataFrame, scenarios: DataFrame, nodes: DataFrame, links: DataFrame,
    allow_observed_roots: bool = True, trees: int = 100, active: bool = False,
) -> Evaluation:
    """`train` and `test` are long telemetry; `scenarios` those of the test period.

    `active` counts every cycle an anomaly lasts as a detection instead of only new and changed ones.
    """
    model = O.fit(train, links, trees=trees)
    cycles = cut(O.observe(train, test, model))
    found = O.emitted(cycles) if not active else cycles.withColumn("ts", F.timestamp_seconds(F.col("cycle") * 60))
    truth = label_times(test.select(F.date_trunc("MINUTE", "ts").alias("ts")), scenarios)
    matrix = E.confusion(truth, found)
    delays = E.time_to_detect(found, scenarios)
    roots = cut(E.root_cause_accuracy(found, scenarios, structural_graph(nodes, links), allow_observed_roots=allow_observed_roots))
    chosen = E.decisions(delays)
    report = matrix
    for part in (E.mean_time_to_detect(delays), E.accuracy(roots), E.decision_summary(chosen)):
        for name in part.columns:
            report = report.withColumn(name, part.select(name).scalar())
    return Evaluation(report, found, delays, roots, chosen)

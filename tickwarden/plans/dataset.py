"""Labelled dataset from telemetry and its scenarios: label times, split at a cutoff, write tables and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.operators.datasets import covered
from tickwarden.operators.intervals import label_times
from tickwarden.operators.reshape import split_at, to_long
from tickwarden.sources.io import scenario_document, write_document, write_splits


def labelled(wide: DataFrame, scenarios: DataFrame, cutoff) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(telemetry with split, ground truth per time, scenarios with split)."""
    truth = label_times(wide.select(F.col("timestamp").alias("ts")), scenarios)
    return split_at(wide, "timestamp", cutoff), truth, split_at(scenarios, "start_time", cutoff)


def build(wide: DataFrame, scenarios: DataFrame, links: DataFrame, cutoff, folder: str, **facts: int) -> None:
    """Write telemetry by split, labels, the readings each scenario covers and the scenario document under `folder`."""
    telemetry, truth, placed = labelled(wide, scenarios, cutoff)
    write_splits(telemetry, f"{folder}/telemetry")
    truth.withColumn("affected_entities", F.to_json("affected_entities")).write.parquet(f"{folder}/ground_truth")
    long = to_long(wide).withColumn("seq", F.unix_micros("ts"))
    covered(long, scenarios, links).write.parquet(f"{folder}/covered")
    write_document(scenario_document(placed, **facts), f"{folder}/scenarios")

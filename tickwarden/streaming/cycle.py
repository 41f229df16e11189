"""The continuous observe cycle: snapshots in, anomaly events out."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwarden.operators.detect import Detector, cycle_peaks, run_ensemble
from tickwarden.session import shared_dir
from tickwarden.sources.io import fan_out
from tickwarden.streaming.processors import readings


def start_observer(
    snapshots: DataFrame, detectors: Sequence[Detector], sinks: dict[str, Callable[[DataFrame, int], None]],
    checkpoint: str, period_seconds: int = 60, failures: Callable[[str, Exception], None] | None = None, **trigger,
):
    """Start the query: every micro-batch is cleaned, run through the stateless detectors and handed to all sinks.

    Detectors with memory run as their own stateful queries (`stream_ewma_anomalies`, `stream_history`). Batches that a
    sink fails to take are kept beside the checkpoint, under `<checkpoint>-dead-letters`.
    """
    deliver = fan_out(sinks, failures, f"{checkpoint.rstrip('/')}-dead-letters")

    def cycle(batch: DataFrame, number: int) -> None:
        found = run_ensemble(batch, detectors).withColumn("cycle", F.floor(F.unix_seconds("ts") / period_seconds))
        deliver(cycle_peaks(found), number)

    writer = readings(snapshots).writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over everything its source holds now and return what it wrote, as a table in the shared folder."""
    spark: SparkSession = stream.sparkSession
    base = folder or os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")

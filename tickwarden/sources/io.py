"""Readers and writers with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwarden.functions.severity import severity_rank
from tickwarden.operators.quality import parse_time
from tickwarden.operators.topology import unique_links
from tickwarden.schemas import SCENARIOS, SNAPSHOT, TELEMETRY_WIDE

_SCENARIO_DOC = T.StructType([
    T.StructField("seed", T.LongType()),
    T.StructField("total_hours", T.LongType()),
    T.StructField("train_hours", T.LongType()),
    T.StructField("test_hours", T.LongType()),
    T.StructField("scenarios", T.ArrayType(T.StructType([
        T.StructField(f.name, T.StringType() if f.name in ("start_time", "end_time") else f.dataType) for f in SCENARIOS
    ]))),
])


def read_telemetry(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Flat telemetry; CSV needs a header."""
    reader = spark.read.schema(TELEMETRY_WIDE)
    return reader.option("header", True).csv(path) if form == "csv" else reader.parquet(path)


def write_telemetry(wide: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Flat telemetry as CSV with a header, columns as `read_telemetry` expects them, times to the microsecond."""
    rows = wide.select(*[F.col(f.name) if f.name in wide.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TELEMETRY_WIDE])
    rows.write.mode(mode).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)


def read_scenarios(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Scenario rows of a nested metadata document, optionally of one split."""
    doc = spark.read.schema(_SCENARIO_DOC).option("multiLine", True).json(path)
    rows = doc.select(F.explode("scenarios").alias("s")).select("s.*")
    rows = rows.withColumns({"start_time": parse_time(F.col("start_time")), "end_time": parse_time(F.col("end_time"))})
    return rows if split is None else rows.where(F.col("split") == split)


def write_splits(rows: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    writer = rows.write.mode(mode).partitionBy("split")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def scenario_document(scenarios: DataFrame, **facts: int) -> DataFrame:
    """One row holding the whole scenario list; the number of scenarios is what the document is about."""
    keep = [F.col(f.name) for f in SCENARIOS if f.name in scenarios.columns]
    listed = scenarios.agg(F.array_sort(F.collect_list(F.struct("start_time", F.struct(*keep).alias("s")))).alias("_s"))
    kinds = [F.lit(v).alias(k) for k, v in facts.items()]
    return listed.select(*kinds, F.transform("_s", lambda e: e["s"]).alias("scenarios"))


def write_document(doc: DataFrame, path: str, mode: str = "errorifexists") -> None:
    doc.write.mode(mode).json(path)


def write_examples(examples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines: one {messages, metadata} per line; a missing metadata key is left out."""
    examples.select("messages", "metadata").write.mode(mode).json(path)


def write_text(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.select("value").write.mode(mode).text(path)


def envelope(rows: DataFrame, kind: str, at: str) -> DataFrame:
    """Event rows {type, payload, ts} as JSON text for a queue or file sink."""
    payload = F.struct(F.lit(kind).alias("type"), F.struct(*rows.columns).alias("payload"), F.col(at).alias("ts"))
    return rows.select(F.to_json(payload).alias("value"))


def append_log(rows: DataFrame, path: str, at: str = "ts") -> None:
    """Append to a log partitioned by day."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Read a log; the day range prunes partitions."""
    rows = spark.read.parquet(path)
    if first_day:
        rows = rows.where(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day:
        rows = rows.where(F.col("day") <= F.lit(last_day).cast("date"))
    return rows


def latest(long: DataFrame) -> DataFrame:
    """Newest reading per (entity, metric)."""
    row = F.max_by(F.struct("ts", "value"), F.struct("ts", "seq")).alias("_r")
    return long.groupBy("entity_id", "metric").agg(row).select("entity_id", "metric", "_r.*")


def recent(rows: DataFrame, n: int = 50, at: str = "ts", tie: str = "seq") -> DataFrame:
    """Newest `n` rows."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(n)


def topology_tables(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node table and one row per undirected link."""
    return nodes, unique_links(links)


def status(anomalies: DataFrame, actions: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: totals over the append-only tables."""
    worst = F.max_by("severity", severity_rank(F.col("severity")))
    return (
        anomalies.agg(F.count("*").alias("anomalies"), worst.alias("worst_severity"), F.max("ts").alias("last_anomaly_ts"))
        .withColumn("actions", actions.agg(F.count("*")).scalar())
        .withColumn("pending", pending.agg(F.count("*")).scalar())
    )


def read_snapshots(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """Stream of nested snapshot documents from a folder of JSON-lines files."""
    reader = spark.readStream.schema(SNAPSHOT)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.json(path)


def parse_snapshots(values: DataFrame, column: str = "value") -> DataFrame:
    """Snapshot documents from a text column (a queue's payload)."""
    return values.select(F.from_json(F.col(column), SNAPSHOT).alias("_s")).select("_s.*")


def fan_out(
    sinks: dict[str, Callable[[DataFrame, int], None]], failures: Callable[[str, Exception], None] | None = None,
    dead_letters: str | None = None,
):
    """A `foreachBatch` body that feeds every sink; one failing sink does not stop the others.

    A batch that a sink could not take is written to `dead_letters`/sink=name/batch=number, so that it can be fed again.
    `failures` is told of it. With neither, the first failure is raised once all sinks have been fed, and the batch is
    run again from the checkpoint.
    """
    def run(batch: DataFrame, number: int) -> None:
        kept, first = batch.persist(), None
        try:
            for name, sink in sinks.items():
                try:
                    sink(kept, number)
                except Exception as error:  # noqa: BLE001 - the other sinks come first
                    first = first or error
                    if dead_letters:
                        kept.write.mode("overwrite").parquet(f"{dead_letters}/sink={name}/batch={number}")
                    if failures:
                        failures(name, error)
        finally:
            kept.unpersist()
        if first and not (failures or dead_letters):
            raise first

    return run


def batch_table(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for `fan_out`: every batch is a part of the table under its number.

    A batch that runs again, after a lost job or out of the dead letters, replaces what it wrote before, so that no row
    is lost or doubled. Read the folder as Parquet; `batch` is a column of it.
    """
    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sink


def feed_again(spark: SparkSession, dead_letters: str, name: str, sink: Callable[[DataFrame, int], None]) -> list[int]:
    """Feed a sink the batches it could not take, oldest first; returns their numbers. Only numbers reach the driver."""
    kept = spark.read.option("basePath", dead_letters).parquet(f"{dead_letters}/sink={name}")
    numbers = [r["batch"] for r in kept.select("batch").distinct().orderBy("batch").collect()]
    for number in numbers:
        sink(kept.where(F.col("batch") == number).drop("sink", "batch"), number)
    return numbers


def report_lines(report: DataFrame) -> DataFrame:
    """Readable lines of a one-row evaluation report."""
    pct = lambda c: F.coalesce(F.format_string("%.1f%%", F.col(c) * 100), F.lit("—"))
    sec = lambda c: F.coalesce(F.format_string("%.1fs", F.col(c)), F.lit("—"))
    lines = F.array(
        F.lit("Anomaly detection"),
        F.format_string("  TP=%d  FP=%d  FN=%d  TN=%d", "tp", "fp", "fn", "tn"),
        F.concat(F.lit("  Precision : "), pct("precision")),
        F.concat(F.lit("  Recall    : "), pct("recall")),
        F.concat(F.lit("  F1 score  : "), pct("f1")),
        F.concat(F.lit("  Mean time to detect : "), sec("mean_mttd_seconds")),
        F.format_string("  Scenarios detected  : %d / %d", "scenarios_detected", "scenarios_total"),
        F.lit("Root cause analysis"),
        F.concat(F.lit("  Accuracy  : "), pct("rca_accuracy")),
        F.lit("Decisions"),
        F.concat(F.lit("  Mean time to mitigate : "), sec("mean_mttm_seconds")),
        F.concat(F.lit("  Safety pass rate      : "), pct("pass_rate")),
    )
    return report.select(F.explode(lines).alias("value"))


def write_batches(rows: DataFrame, folder: str, batch: str, files: int = 4) -> list:
    """Write rows into `folder` in the order of their batch number, `files` files each, for a replay as a stream.

    Read with `maxFilesPerTrigger` = `files`, every batch becomes one micro-batch. Returns the batch numbers.
    """
    numbers = [r[0] for r in rows.select(batch).distinct().orderBy(batch).collect()]
    for number in numbers:
        rows.where(F.col(batch) == F.lit(number)).drop(batch).repartition(files).write.mode("append").parquet(folder)
    return numbers

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.conftest import minute
from tickwarden.operators import detect as D
from tickwarden.sources import io
from tickwarden.streaming import observe as SO
from tickwarden.streaming import processors as SP
from tickwarden.streaming.cycle import drain, start_observer


def feed(spark, rows, schema, folder, files=1):
    frame = spark.createDataFrame(rows, schema)
    frame.repartition(files).write.parquet(folder)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", "5 minutes")


LONG = "ts timestamp, entity_id string, entity_type string, metric string, value double, seq bigint"


def test_stream_equals_batch_ewma(spark, tmp_path):
    rows = [(minute(i), e, "node", "cpu_pct", float((i * 37) % 23) + (80 if i == 25 else 0), i) for i in range(40) for e in ("A", "B")]
    stream = feed(spark, rows, LONG, str(tmp_path / "in"))
    got = {(r["entity_id"], r["seq"]): (round(r["mean_before"], 9), round(r["var_before"], 9)) for r in drain(SP.stream_ewma(stream), str(tmp_path / "w")).collect()}
    batch = D.ewma(spark.createDataFrame(rows, LONG))
    assert got == {(r["entity_id"], r["seq"]): (round(r["mean_before"], 9), round(r["var_before"], 9)) for r in batch.collect()}


def test_rate_limit_ignores_rejected(spark, tmp_path):
    rows = [(f"a{i}", minute(t), "all") for i, t in enumerate([0, 1, 2, 3, 9, 10.5, 11, 11.5])]
    out = drain(SP.stream_rate_limit(feed(spark, rows, "action_id string, ts timestamp, scope string", str(tmp_path / "in"))), str(tmp_path / "w"))
    assert [r["accepted"] for r in out.orderBy("ts").collect()] == [True, True, True, False, False, True, False, True]


def test_lifecycle_changes(spark, tmp_path):
    rows = [(minute(c), c, "A", "m", s, f) for c, s, f in [(1, "high", 0.70), (2, "high", 0.73), (3, "high", 0.82), (6, "high", 0.82)]]
    start = int(minute(0).timestamp() // 60)
    # A weaker row of a cycle changes nothing, and a much later one of another key lets the watermark pass.
    rows += [(minute(2), 2, "A", "m", "low", 0.99), (minute(60), 60, "B", "m", "low", 0.5)]
    rows = [(t, start + c, e, m, s, f) for t, c, e, m, s, f in rows]
    stream = feed(spark, rows, "ts timestamp, cycle bigint, entity_id string, metric string, severity string, confidence double", str(tmp_path / "in"))
    out = drain(SP.stream_lifecycle(stream), str(tmp_path / "w"))
    seen = {(r["cycle"] - start, r["change"]) for r in out.collect()}
    assert {(1, "new"), (2, "unchanged"), (3, "changed"), (4, "resolved"), (6, "new")} <= seen
    assert seen == {(1, "new"), (2, "unchanged"), (3, "changed"), (4, "resolved"), (6, "new"), (7, "resolved")}


def test_observer_stream_and_failing_sink(spark, tmp_path):
    docs = [{"timestamp": minute(i).isoformat(), "nodes": {"CR1": {"cpu_pct": 95.0 if i == 2 else 50.0}}, "links": {}} for i in range(4)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(d) for d in docs))
    kept, failed = [], []

    def broken(batch, number):
        raise RuntimeError("sink is down")

    sinks = {"broken": broken, "good": lambda batch, number: kept.extend(batch.select("entity_id", "severity").collect())}
    query = start_observer(io.read_snapshots(spark, str(tmp_path / "in")), [D.threshold()], sinks, str(tmp_path / "state"))
    query.awaitTermination()
    assert [(r["entity_id"], r["severity"]) for r in kept] == [("CR1", "medium")]
    assert io.fan_out({"broken": broken}, lambda name, e: failed.append(name))(spark.range(1), 0) is None and failed == ["broken"]
    assert SP.late_rows(query) == 0


def test_logs_prune_by_day(spark, tmp_path):
    rows = spark.createDataFrame([(minute(0), 1), (minute(3000), 2)], "ts timestamp, n int")
    io.append_log(rows, str(tmp_path / "log"))
    io.append_log(rows, str(tmp_path / "log"))
    assert io.read_log(spark, str(tmp_path / "log")).count() == 4
    assert io.read_log(spark, str(tmp_path / "log"), "2024-01-02").agg(F.min("n"), F.count("*")).first()[:] == (2, 2)


def test_lost_job_and_dead_letters_neither_lose_nor_double_rows(spark, tmp_path):
    rows = [(minute(i), f"E{i % 3}", "node", "cpu_pct", float(i), i) for i in range(24)]
    stream = feed(spark, rows, LONG, str(tmp_path / "in"), files=4)
    table, other, state = (str(tmp_path / n) for n in ("table", "other", "state"))
    lost, dead = [], str(tmp_path / "dead")

    def run(body, checkpoint):
        stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def dies_after_writing(batch, number):
        io.batch_table(table)(batch, number)
        if number == 1 and not lost:
            lost.append(number)
            raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        run(io.fan_out({"table": dies_after_writing}), state)
    run(io.fan_out({"table": dies_after_writing}), state)
    assert lost == [1]
    assert sorted(r["seq"] for r in spark.read.parquet(table).collect()) == list(range(24))

    def refuses(batch, number):
        if number in (1, 2):
            raise RuntimeError("refused")
        io.batch_table(other)(batch, number)

    run(io.fan_out({"other": refuses}, dead_letters=dead), str(tmp_path / "again"))
    assert spark.read.parquet(other).count() < 24
    for _ in range(2):
        assert io.feed_again(spark, dead, "other", io.batch_table(other)) == [1, 2]
    back = spark.read.parquet(other)
    assert sorted(r["seq"] for r in back.collect()) == list(range(24)) and back.columns == [*stream.columns, "batch"]


def test_stateful_steps_are_called_per_share_not_per_key(spark, tmp_path):
    rows = [(minute(m), f"E{i}", "node", "cpu_pct", float(i + m), 1000 * m + i) for m in range(3) for i in range(300)]
    rows += [(minute(60), "END", "node", "cpu_pct", 1.0, 99999)]
    stream = feed(spark, rows, LONG, str(tmp_path / "in"))
    cycles = stream.withColumns({"cycle": F.floor(F.unix_seconds("ts") / 60), "severity": F.lit("high"), "confidence": F.col("value") / 1000})
    for name, work in {
        "late": lambda n: SP.mark_late(stream, n_shares=n),
        "lifecycle": lambda n: SP.stream_lifecycle(cycles.drop("value", "entity_type"), n_shares=n),
        "closed": lambda n: SO.closed_readings(stream, n_shares=n).drop("history"),
    }.items():
        query = work(4).writeStream.format("noop").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        held = max([op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]])
        assert held <= 4, name
        few, many = (sorted(map(tuple, drain(work(n), str(tmp_path / f"{name}{n}")).collect())) for n in (1, 4096))
        assert few == many and len(few) >= 900

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
LIGHT = [
    "baseline_mean", "threshold_anomalies", "ensemble_dedup", "emit_changes", "forecast_confidence", "history_60", "gap_fill",
    "ground_truth_labels", "structural_edges", "outcome_label", "success_rate", "parse_hypotheses", "topk_vectors", "chunk_fixed",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", LIGHT)
def test_query_agrees_with_its_sql(spark, db, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert compare(got, db.execute(entry.oracle_sql()[name]).fetchdf()).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

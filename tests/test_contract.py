"""The registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import glob
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as contract  # noqa: E402
from check_oracle import compare  # noqa: E402
from tugboard.workload import oracle, queries  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    opened = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        opened.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return opened


def test_every_query_has_its_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql()) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_equals_sql(spark, connection, name):
    verdict = compare(spark, connection, TABLES, name)
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and {"session_id", "param", "user", "control_seconds"} <= set(rows[0].asDict())

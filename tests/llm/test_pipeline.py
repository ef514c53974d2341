"""The pipeline against a plain version of its stages, and the contract's entries."""

from __future__ import annotations

import glob
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tools"), str(ROOT / "tests" / "llm")]

import __spark_entry__ as contract  # noqa: E402
import corpus_pipeline  # noqa: E402
import plain  # noqa: E402
from check_oracle import compare  # noqa: E402
from tugboard.llm import oracle, queries  # noqa: E402

TABLES = "/root/testdata/sf0.001"


def test_every_operator_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 11)) and "pipeline" in names
    assert set(oracle.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", list(oracle.oracle_sql()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        connection.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    verdict = compare(spark, connection, TABLES, name)
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


def test_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, TABLES)
    assert good.dtypes == docs.dtypes
    rows = {r.doc_id: r.text for r in good.collect()}

    def failed(m):
        return m[0] < 50 or 100 * m[4] > 50 * m[0]

    measured = {d: plain.measures(r.text) for d, r in before.items()}
    hosts = {r.source for r in before.values()}
    rejected = {h for h in hosts if not any(before[d].source == h for d in rows)}
    assert set(rows) == {d for d, m in measured.items() if not failed(m) and before[d].source not in rejected}
    for h in rejected:
        assert 2 * sum(failed(measured[d]) for d in before if before[d].source == h) > sum(r.source == h for r in before.values())
    lines = stages["line dedup"](spark, good, TABLES)
    expected = plain.dedup_lines(rows)
    shorter = {r.doc_id: r.text for r in lines.collect()}
    assert lines.dtypes == docs.dtypes and {d: plain.sha(t.encode()) for d, t in shorter.items()} == {d: x[2] for d, x in expected.items()}
    single = stages["simhash near-dedup"](spark, lines, TABLES)
    left = {r.doc_id: r for r in single.collect()}
    assert single.dtypes == docs.dtypes and set(left) == {d for d, (_, c) in plain.simhash_groups(shorter).items() if c == d}
    mixed = stages["source mixing"](spark, single, TABLES)
    sizes, taken = {}, {}
    for r in left.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(plain.WORD.findall(r.text))
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(plain.WORD.findall(r.text))
    for s, target in plain.targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 128 + 0.03 * target
    assert mixed.dtypes == docs.dtypes


def test_run(spark):
    rows = corpus_pipeline.run(spark, TABLES).collect()
    assert rows and all(len(r.ids_sha256) == len(r.decoded_sha256) == 64 and r.n_tokens >= 0 for r in rows)

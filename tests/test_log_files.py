from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from tugboard.config import DEFAULTS
from tugboard.plans.ordered import SLICES_A_CORE, slices_of
from tugboard.sources import lines as line_source
from tugboard.sources.lines import read_lines
from tugboard.workload.derived_text import _log_files, control_lines, imu_lines


def test_many_small_files_share_tasks(spark, tmp_path):
    """Each scan split holds few small files: there are more of them than tasks, and each keeps its numbers."""
    for n in range(240):
        (tmp_path / f"User{n}.log").write_text(f"a{n}\nb{n}\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        found = read_lines(spark, str(tmp_path), "User*.log")
        splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        most = line_source.TASKS_A_CORE * spark.sparkContext.defaultParallelism
        assert found.rdd.getNumPartitions() == most < splits
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.mid for r in rows}) == len(rows) == 720
    by_file = {}
    for r in sorted(rows, key=lambda r: (r.file, r.block_start, r.mid)):
        by_file.setdefault(r.file.rpartition("/")[2], []).append(r.line)
    assert by_file == {f"User{n}.log": [f"a{n}", f"b{n}", ""] for n in range(240)}


def test_tasks_write_the_logs(spark, tmp_path):
    """One file per log, its lines in order, nothing moved by the driver; rows without a user are in no log."""
    users = [0, 1, 1, 5, 5, 5, None, 9]
    rows = [(n, datetime(2024, 1, 1, 0, 0, n), u, "click", float(n)) for n, u in enumerate(users)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    lines = control_lines(spark, str(tmp_path))
    folder = Path(_log_files(spark, str(tmp_path), "control", lines).removeprefix("file:"))
    expected = {}
    for r in sorted(lines.where(F.col("file").isNotNull()).collect(), key=lambda r: r.mid):
        expected.setdefault(r.file, []).append(r.line)
    written = [p for p in folder.glob("*/*/*")]
    assert {f"{p.parent.name.removeprefix('session_id=')}/{p.name}": p.read_text().split("\n")[:-1] for p in written} == expected
    assert len(written) == 4
    assert not [p for p in folder.rglob("*") if "part-" in p.name or "_SUCCESS" in p.name]


def test_no_lines_give_an_empty_folder(spark, tmp_path):
    none = spark.createDataFrame([], "session_id string, file string, block_start long, mid long, line string")
    assert read_lines(spark, _log_files(spark, str(tmp_path), "none", none), "*").count() == 0


def test_slices_follow_the_cores_until_they_are_large():
    small = replace(DEFAULTS, slice_rows=5000)
    assert slices_of(100_000, small, 12) == 20
    assert slices_of(36_000_000, small, 12) == SLICES_A_CORE * 12
    # Never so few that a slice holds more than the rows aimed at for large data.
    assert slices_of(1_000 * DEFAULTS.slice_rows, small, 4) == 1_000
    assert slices_of(1_000 * DEFAULTS.slice_rows, DEFAULTS, 4) == 1_000


def test_sensor_lines_are_those_of_a_formatter(spark, tmp_path):
    """Written without a formatter, missing values still read null, as it writes them."""
    rows = [(n, datetime(2024, 1, 1, 0, 0, 1), 4, "click", None if n == 2 else -n / 4) for n in (2, 3, 15)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    lines = imu_lines(spark, str(tmp_path))
    assert "format_string" not in lines._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.mid, r.line) for r in lines.collect()}
    head = "00:00:01.000000 Gyroscope = SensorInfo { Timestamp = %s, Accuracy = 3, Data = <%s, -%s, 0.5> }"
    assert {(17, head % (10, "null", "null")), (25, head % (15, "-0.75", "-0.75")), (121, head % (75, "1E-4", "-3.75"))} <= found
    assert (20, "Gravity = SensorInfo { Timestamp = 13, Accuracy = 3, Data = <0.0, 9.8, null> }") in found

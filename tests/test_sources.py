from __future__ import annotations

import gzip

import pytest

from tugboard.sources.control_logs import (
    parse_control_events,
    parse_control_events_strict,
    read_control_logs,
    rejected_lines,
)
from tugboard.sources.sinks import write_change_segments, write_control_events, write_imu_records
from tugboard.config import PanelSettings
from tugboard.operators.activity import time_in_control
from tugboard.operators.grid import merged_series
from tugboard.operators.roster import parse_summary
from tugboard.operators.segments import change_segments

EDGE_LINES = [
    "10:00:00.100 User 1 sets Frequency to 2.5.",
    "10:00:00.200 sets phase shift to -.5",
    "10:00:01.0 User 2 resets amplitude to +3",
    "10:00:02.0 User 3 sets mode to fast to 7",
    "10:00:03 User 1 sets x to 1",
    "10:00:04.5 User 1 sets a to 1 User 2 sets b to 2",
    "110:00:05.0 User1sets OFFSET to 1e5",
    "10:00:06.0 sets a1 to 3",
    "10:00:07.0 User 4 sets bad to zz then User 5 sets q to 1.2.3",
    "",
    "10:00:08.0 user 3 SETS Gain  to 12. and more",
    "10:00:09.0 sets gain to -",
    "10:00:10.0 User 99999999999 sets gain to 4",
    "10:00:11.0 User 99999999999999999999 sets gain to 5",
]


def write(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def listed(events):
    return [(r.time, r.user, r.param, r.value) for r in events.orderBy("file", "block_start", "mid").collect()]


@pytest.fixture()
def logs(tmp_path):
    write(tmp_path, "User7.log", EDGE_LINES)
    write(tmp_path, "notes.txt", ["10:00:00.100 User 1 sets frequency to 2.5"])
    return tmp_path


def test_lenient_lines(spark, logs):
    assert listed(parse_control_events(read_control_logs(spark, str(logs)))) == [
        ("10:00:00.100", 1, "frequency", 2.5),
        ("10:00:00.200", 7, "phase shift", -0.5),
        ("10:00:01.0", 7, "amplitude", 3.0),
        ("10:00:02.0", 3, "mode to fast", 7.0),
        ("10:00:04.5", 1, "a", 1.0),
        ("10:00:05.0", 1, "offset", 1.0),
        ("10:00:07.0", 5, "q", 1.2),
        ("10:00:08.0", 3, "gain", 12.0),
        ("10:00:10.0", 99999999999, "gain", 4.0),
    ]


def test_strict_lines(spark, logs):
    lines = read_control_logs(spark, str(logs))
    assert listed(parse_control_events_strict(lines)) == [
        ("10:00:00.200", 7, "phase shift", -0.5),
        ("10:00:02.0", 3, "mode to fast", 7.0),
        ("10:00:04.5", 1, "a", 1.0),
        ("10:00:05.0", 1, "OFFSET", 1.0),
        ("10:00:08.0", 3, "Gain", 12.0),
        ("10:00:10.0", 99999999999, "gain", 4.0),
    ]
    rejected = sorted(r.value_text for r in rejected_lines(lines, strict=True).collect())
    assert rejected == ["-", "1.2.3", "2.5.", "5"]
    assert [r.user_text for r in rejected_lines(lines).collect()] == ["99999999999999999999"]


def test_time_and_schema(spark, logs):
    events = parse_control_events(read_control_logs(spark, str(logs)))
    assert events.dtypes == [
        ("session_id", "string"), ("file", "string"), ("block_start", "bigint"), ("mid", "bigint"),
        ("time", "string"), ("user", "bigint"), ("param", "string"), ("value", "double"), ("time_sec", "double"),
    ]
    assert events.where("time = '10:00:04.5'").first().time_sec == 36004.5


def test_fail_fast(spark, logs):
    lines = read_control_logs(spark, str(logs))
    with pytest.raises(Exception, match="unreadable change"):
        parse_control_events_strict(lines, fail_fast=True).collect()


def test_a_file_without_a_number_has_no_user(spark, tmp_path):
    write(tmp_path, "Users.log", ["10:00:00.5 sets a to 1", "10:00:00.5 User 3 sets a to 2"])
    lines = read_control_logs(spark, str(tmp_path))
    assert listed(parse_control_events(lines)) == [("10:00:00.5", 3, "a", 2.0)]
    assert rejected_lines(lines).count() == 1


def test_empty_input(spark, tmp_path):
    write(tmp_path, "User1.log", ["nothing here"])
    lines = read_control_logs(spark, str(tmp_path))
    assert parse_control_events(lines).count() == 0
    for parse in (parse_control_events, parse_control_events_strict):
        with pytest.raises(ValueError, match="no parameter changes"):
            parse(lines, require_nonempty=True)


def test_line_order_survives_splits(spark, tmp_path):
    for user in (1, 2):
        write(tmp_path, f"User{user}.log", [f"10:00:00.0 sets a to {k}" for k in range(4000)])
    with gzip.open(tmp_path / "User3.log.gz", "wt") as packed:
        packed.writelines(f"10:00:00.0 sets a to {k}\n" for k in range(50))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        lines = read_control_logs(spark, str(tmp_path), glob="User*.log*")
        assert lines.select("file", "block_start").distinct().count() > 6
        events = parse_control_events(lines).orderBy("file", "block_start", "mid").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for user, n in ((1, 4000), (2, 4000), (3, 50)):
        assert [r.value for r in events if r.user == user] == [float(k) for k in range(n)]


def test_event_and_segment_sinks(spark, logs, tmp_path):
    events = parse_control_events(read_control_logs(spark, str(logs)))
    write_control_events(events, str(tmp_path / "events"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "events")).collect()
    assert len(rows) == 9 and rows[0].asDict() == {
        "time": "10:00:00.100", "user": "1", "param": "frequency", "value": "2.5", "time_sec": "36000.1"
    }
    write_change_segments(change_segments(events), str(tmp_path / "segments"))
    parts = list((tmp_path / "segments").glob("part-*.csv"))
    assert parts[0].read_text().splitlines() == ["user,param,start_time,end_time,from_value,to_value"]
    summary = parse_summary(events).first()
    assert (summary.n_changes, summary.n_users, summary.n_params) == (9, 5, 8)


def test_imu_sink_header(spark, tmp_path):
    from tugboard.sources.imu_logs import IMU_COLUMNS, parse_imu_records, read_imu_logs

    write(tmp_path, "imu_log.txt", ["nothing"])
    write_imu_records(parse_imu_records(read_imu_logs(spark, str(tmp_path))), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text().strip()
    assert text.split(",") == IMU_COLUMNS and len(IMU_COLUMNS) == 27


def test_analysis_of_parsed_lines(spark, logs):
    events = parse_control_events(read_control_logs(spark, str(logs)))
    settings = PanelSettings(shared_params=("gain",))
    owners = {r.user: r.control_seconds for r in time_in_control(events, settings).where("param = 'gain'").collect()}
    assert owners[3] == pytest.approx(2.0)
    assert {r.owner for r in merged_series(events, settings).where("param = 'gain'").collect()} == {None, 3}

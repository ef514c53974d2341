"""CSV outputs. Every sink writes a header, also for no rows, and one sorted run of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tugboard.config import LINE
from tugboard.sources.imu_logs import IMU_COLUMNS

EVENT_CSV = ("time", "user", "param", "value", "time_sec")
SEGMENT_CSV = ("user", "param", "start_time", "end_time", "from_value", "to_value")


def _write(rows: DataFrame, order: Sequence[str], columns: Sequence[str], path: str, keep_session: bool) -> None:
    shown = ["session_id", *columns] if keep_session else list(columns)
    leading = ["session_id", *order] if keep_session else list(order)
    rows.orderBy(*leading).select(*shown).write.option("header", True).mode("errorifexists").csv(path)


def write_control_events(events: DataFrame, path: str, keep_session: bool = False) -> None:
    _write(events, ["time_sec", "user", "param", *LINE], EVENT_CSV, path, keep_session)


def write_change_segments(segments: DataFrame, path: str, keep_session: bool = False) -> None:
    _write(segments, ["user", "param", "start_time", "end_time"], SEGMENT_CSV, path, keep_session)


def write_imu_records(records: DataFrame, path: str, keep_session: bool = False) -> None:
    _write(records, ["file", "record_no"], IMU_COLUMNS, path, keep_session)

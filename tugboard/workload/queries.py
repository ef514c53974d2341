"""Every operator as a query over the events table. Floating columns are rounded for comparison."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tugboard.config import PanelSettings
from tugboard.operators import activity, carefulness, conflicts, grid, reports, roster, segments, synchrony, views
from tugboard.sources import control_logs, imu_logs
from tugboard.session import ensure_checkpoint_dir
from tugboard.sources.event_table import SEATS, read_event_table
from tugboard.sources.session_store import SessionStore, read_session_store, write_session_store
from tugboard.workload.derived_text import control_lines, control_log_files, imu_log_files

# The table is sparse, so the thresholds are stretched: five times finer than a window, as far as a
# window lasts two days.
STRETCHED = PanelSettings(
    tick=21_600.0,
    conflict_window=172_800.0,
    merge_gap=69_120.0,
    long_gap=345_600.0,
    viewport=432_000.0,
    shared_params=("click", "view"),
)
# The layout of large data, forced on small tables: slices, salted joins, chains.
FORCED = replace(
    STRETCHED, hot_rows=20, slice_rows=5000, broadcast_rows=10, fan_out=4, fold_rows=2, chain_rows=200
)
VIEW_USERS = (0, 2)
VIEW_PARAMS = ("click", "error", "signup")
PAGE_OFFSET = 9
LATE_START = 1_705_708_800.0   # the twentieth day of the table
STORE_BLOCK = 345_600.0        # four days, a little less than a viewport
STORE_BUCKETS = 8
REPORT_USER = 1
DIGITS = 6

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[
        F.round(name, DIGITS).alias(name) if kind == "double" else F.col(name) for name, kind in rows.dtypes
    ])


def _on_events(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _rounded(operator(read_event_table(spark, sf_dir)))


def _listed_users(rows: DataFrame) -> DataFrame:
    return rows.withColumn("users", F.array_join(F.transform("users", lambda u: u.cast("string")), ","))


def _maps_as_text(rows: DataFrame) -> DataFrame:
    def text(name: str, digits: int | None):
        def entry(e):
            value = e["value"] if digits is None else F.round(e["value"], digits).cast("bigint")
            return F.concat_ws("=", e["key"], value.cast("string"))
        return F.array_join(F.transform(F.array_sort(F.map_entries(name)), entry), ";")

    return rows.withColumns({
        "param_changes": text("param_changes", None),
        "time_in_control": text("time_in_control", 0),
    })


def _zones(events: DataFrame) -> DataFrame:
    return conflicts.detect_conflicts(events, STRETCHED)


def _zone_stats(events: DataFrame) -> DataFrame:
    return conflicts.zone_value_stats(_zones(events), events, STRETCHED)


def _events_from_text(strict: bool) -> Query:
    parse = control_logs.parse_control_events_strict if strict else control_logs.parse_control_events
    return lambda spark, sf_dir: _rounded(parse(control_lines(spark, sf_dir)).drop("block_start"))


def _segments_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of a log: files, strict lines, changes in the order of time, file and line."""
    return segments.change_segments(control_logs.parse_control_events_strict(control_log_files(spark, sf_dir)), PanelSettings())


# Folders of stores by session and table folder; the store is what its readers start from, and is written once.
_stores: dict[tuple[str, str], str] = {}


def _store(spark: SparkSession, sf_dir: str) -> SessionStore:
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _stores:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4()}"
        write_session_store(read_event_table(spark, sf_dir), folder, STORE_BLOCK, STORE_BUCKETS)
        _stores[known] = folder
    return read_session_store(spark, _stores[known])


def queries() -> dict[str, Query]:
    on = _on_events
    s = STRETCHED
    return {
        # sources
        "parse_control_events": _events_from_text(strict=False),
        "parse_control_events_strict": _events_from_text(strict=True),
        "rejected_lines": lambda spark, d: control_logs.rejected_lines(
            control_lines(spark, d), strict=True
        ).drop("block_start"),
        "parse_imu_records": lambda spark, d: imu_logs.parse_imu_records(imu_log_files(spark, d)),
        "imu_numeric_cast": lambda spark, d: _rounded(
            imu_logs.imu_numeric_cast(imu_logs.parse_imu_records(imu_log_files(spark, d)))
        ),
        "imu_bad_cells": lambda spark, d: imu_logs.imu_bad_cells(imu_logs.parse_imu_records(imu_log_files(spark, d))),
        "imu_numeric_columns": lambda spark, d: _rounded(
            imu_logs.imu_numeric_columns(imu_logs.parse_imu_records(imu_log_files(spark, d)))
        ),
        "parse_imu_framed": lambda spark, d: imu_logs.parse_imu_framed(imu_log_files(spark, d)),
        "imu_rejects": lambda spark, d: imu_logs.imu_rejects(imu_log_files(spark, d)),
        # The place of a line in its file is the reader's, so what tells it is left out.
        "parse_control_log_files": lambda spark, d: _rounded(
            control_logs.parse_control_events(control_log_files(spark, d)).drop("block_start", "mid")
        ),
        "rejected_lines_of_files": lambda spark, d: control_logs.rejected_lines(
            control_log_files(spark, d), strict=True
        ).drop("block_start", "mid"),
        "change_segments_of_files": lambda spark, d: _rounded(_segments_of_files(spark, d)),
        "parse_summary": on(roster.parse_summary),
        # who and what
        "session_bounds": on(lambda e: roster.session_bounds(e, s)),
        "distinct_users": on(roster.distinct_users),
        "distinct_params": on(roster.distinct_params),
        "user_change_counts": on(roster.user_change_counts),
        "param_change_counts": on(roster.param_change_counts),
        # segments
        "change_segments": on(lambda e: segments.change_segments(e, s)),
        "change_segments_preview": on(lambda e: segments.change_segments_preview(e, s)),
        # the grid
        "locf_series": on(lambda e: grid.locf_series(e, s)),
        "merged_series": on(lambda e: grid.merged_series(e, s)),
        "ownership_segments": on(lambda e: grid.ownership_segments(e, s)),
        "series_wide": on(lambda e: grid.series_wide(e, range(SEATS), s)),
        "pairwise_synchrony": on(lambda e: synchrony.pairwise_synchrony(e, s)),
        # activity
        "time_in_control": on(lambda e: activity.time_in_control(e, s)),
        "inactivity_gaps": on(lambda e: activity.inactivity_gaps(e, s)),
        "activity_span": on(activity.activity_span),
        "user_activity": on(lambda e: _maps_as_text(activity.user_activity(e, s))),
        "engagement_distribution": on(activity.engagement_distribution),
        "most_active_user": on(activity.most_active_user),
        "most_dominant_user": on(lambda e: activity.most_dominant_user(e, s)),
        "most_responsive_user": on(activity.most_responsive_user),
        # carefulness
        "carefulness": on(lambda e: carefulness.carefulness(e, s)),
        "carefulness_summary": on(lambda e: carefulness.carefulness_summary(e, s)),
        "carefulness_summary_judged": on(lambda e: carefulness.carefulness_summary(e, s, skip_without_data=True)),
        "carefulness_report": on(lambda e: reports.carefulness_report(e, s)),
        "carefulness_report_one_user": on(lambda e: reports.carefulness_report(e, s, REPORT_USER)),
        # conflicts
        "conflict_candidates": on(lambda e: conflicts.conflict_candidates(e, s)),
        "conflict_candidates_three_users": on(
            lambda e: conflicts.conflict_candidates(e, replace(s, min_users=3))
        ),
        "detect_conflicts": on(lambda e: _listed_users(_zones(e))),
        "conflict_report": on(lambda e: conflicts.conflict_report(_zones(e))),
        "zone_value_stats": on(_zone_stats),
        # Not rounded: halves of microseconds lie on the rounding edge, and both sides compute alike.
        "conflict_annotations": lambda spark, d: conflicts.conflict_annotations(
            _zone_stats(read_event_table(spark, d))
        ),
        # views
        "select_view": on(lambda e: views.select_view(e, VIEW_USERS, VIEW_PARAMS, s)),
        "time_viewport": on(lambda e: views.time_viewport(e, settings=s)),
        "time_viewport_full": on(lambda e: views.time_viewport(e, full=True, settings=s)),
        "time_viewport_late": on(lambda e: views.time_viewport(e, LATE_START, settings=s)),
        "time_viewport_stored": lambda spark, d: _rounded(views.stored_viewport(_store(spark, d), LATE_START, s)),
        "time_in_control_stored": lambda spark, d: _rounded(activity.time_in_control(_store(spark, d).events, s)),
        "param_page": on(lambda e: views.param_page(e, PAGE_OFFSET, s)),
        # reports
        "session_overview": on(lambda e: reports.session_overview(e, s)),
        "session_report": on(lambda e: reports.session_report(e, s)),
        "stats_panel": on(lambda e: reports.stats_panel(e, s)),
        "comparative_report": on(lambda e: reports.comparative_report(e, s)),
        "param_page_first": on(lambda e: views.param_page(e, 0, s)),
        # the same operators by the plans for large data
        "change_segments_sliced": on(lambda e: segments.change_segments(e, FORCED)),
        "inactivity_gaps_sliced": on(lambda e: activity.inactivity_gaps(e, FORCED)),
        "time_in_control_sliced": on(lambda e: activity.time_in_control(e, FORCED)),
        "carefulness_sliced": on(lambda e: carefulness.carefulness(e, FORCED)),
        "conflict_candidates_sliced": on(lambda e: conflicts.conflict_candidates(e, FORCED)),
        "conflict_candidates_three_users_sliced": on(
            lambda e: conflicts.conflict_candidates(e, replace(FORCED, min_users=3))
        ),
        "detect_conflicts_sliced": on(lambda e: _listed_users(conflicts.detect_conflicts(e, FORCED))),
        "zone_value_stats_sliced": on(
            lambda e: conflicts.zone_value_stats(conflicts.detect_conflicts(e, FORCED), e, FORCED)
        ),
    }

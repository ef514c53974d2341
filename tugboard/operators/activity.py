"""Dominance, activity and involvement of the users of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tugboard.config import DEFAULTS, PanelSettings
from tugboard.functions.cells import bar, padded_bar, per_minute, share_percent
from tugboard.operators.grid import merged_runs
from tugboard.operators.roster import (
    change_counts,
    session_bounds,
    user_change_counts,
    user_totals,
    users_by_params,
)
from tugboard.plans.ordered import combine_large, order_groups

USER = ["session_id", "user"]
SERIES = [*USER, "param"]


def owned_ticks(events: DataFrame, settings: PanelSettings) -> DataFrame:
    """Ticks under each owner of a shared parameter: run lengths added up, no tick spelled out."""
    return (
        merged_runs(events, settings, settings.shared_params)
        .groupBy("session_id", "param", F.col("owner").alias("user"))
        .agg(F.sum(F.col("hi") - F.col("lo")).alias("ticks"))
    )


def control_seconds(settings: PanelSettings) -> Column:
    """Owned ticks times the resolution; NULL for parameters that are not shared."""
    seconds = F.coalesce("ticks", F.lit(0)) * F.lit(settings.tick)
    return F.when(F.col("param").isin(*settings.shared_params), seconds)


def time_in_control(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """Seconds each user owned each shared parameter, zeros included, and percent of the session."""
    counts = change_counts(events, keep=True)
    seconds = control_seconds(settings)
    return (
        users_by_params(counts, settings.shared_params)
        .join(owned_ticks(events, settings), SERIES, "left")
        .join(session_bounds(events, settings).select("session_id", "duration"), "session_id")
        .select(
            "session_id",
            "param",
            "user",
            seconds.alias("control_seconds"),
            share_percent(seconds, F.col("duration")).alias("control_percent"),
        )
    )


def _gaps(events: DataFrame, settings: PanelSettings) -> DataFrame:
    """Per user with more than one instant: the largest gap and the number of long gaps.

    Changes of one instant have no gap between them, whatever their order. In large sessions each
    instant is kept once before anything is put in order.
    """
    counts = change_counts(events, keep=True)
    instants = combine_large(events.select(*USER, "time_sec"), counts, settings, DataFrame.distinct)
    ordered = order_groups(instants, USER, ["time_sec"], settings, counts)
    gap = F.col("time_sec") - F.col("before")
    return (
        ordered.previous(before="time_sec").done()
        .select(*USER, gap.alias("gap"))
        .groupBy(*USER)
        .agg(F.max("gap").alias("largest"), F.count_if(F.col("gap") > settings.long_gap).alias("long"))
    )


def _with_gaps(users: DataFrame, events: DataFrame, settings: PanelSettings) -> DataFrame:
    # The mean gap needs no order: it is the span over the number of gaps.
    span = F.col("last_action_time") - F.col("first_action_time")
    return users.join(_gaps(events, settings), USER).withColumns({
        "max_inactivity_gap": F.coalesce("largest", F.lit(0.0)),
        "avg_gap_between_changes": F.coalesce(F.try_divide(span, F.col("total_changes") - 1), F.lit(0.0)),
        "long_inactivity_periods": F.col("long"),
    })


def _with_span(users: DataFrame) -> DataFrame:
    active = F.col("last_action_time") - F.col("first_action_time")
    return users.withColumns({
        "active_duration": active,
        "activity_percentage": share_percent(active, F.col("duration")),
    })


def inactivity_gaps(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """Longest and mean gap between a user's changes, over all parameters, and the number of long ones."""
    return _with_gaps(user_totals(events), events, settings).select(
        *USER, "max_inactivity_gap", "avg_gap_between_changes", "long_inactivity_periods"
    )


def activity_span(events: DataFrame) -> DataFrame:
    """First and last action of each user, the time between, and its percent of the session."""
    return _with_span(user_totals(events)).select(
        *USER, "first_action_time", "last_action_time", "active_duration", "activity_percentage"
    )


def activity_record(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """The measures of each user that are single numbers."""
    return _with_span(_with_gaps(user_totals(events), events, settings)).select(
        *USER,
        "total_changes",
        per_minute(F.col("total_changes"), F.col("duration")).alias("changes_per_minute"),
        "max_inactivity_gap",
        "avg_gap_between_changes",
        "long_inactivity_periods",
        "first_action_time",
        "last_action_time",
        "active_duration",
        "activity_percentage",
    )


def user_activity(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """The full record of each user, with maps parameter -> changes and parameter -> seconds in control."""
    seconds = control_seconds(settings)
    # One entry per parameter of the session; a NULL entry is not collected.
    changes = F.collect_list(F.struct("param", "changes"))
    control = F.collect_list(F.when(seconds.isNotNull(), F.struct("param", seconds.alias("seconds"))))
    maps = (
        users_by_params(change_counts(events, keep=True))
        .join(owned_ticks(events, settings), SERIES, "left")
        .groupBy(*USER)
        .agg(
            F.map_from_entries(F.array_sort(changes)).alias("param_changes"),
            F.map_from_entries(F.array_sort(control)).alias("time_in_control"),
        )
    )
    return activity_record(events, settings).join(maps, USER)


def _user_counts(events: DataFrame, keep: bool = False) -> DataFrame:
    return change_counts(events, keep).groupBy(*USER).agg(F.sum("changes").alias("total_changes"))


def engagement_distribution(events: DataFrame) -> DataFrame:
    """Each user's share of all changes of the session, with its bar."""
    counts = _user_counts(events, keep=True)
    sessions = counts.groupBy("session_id").agg(F.sum("total_changes").alias("all_changes"))
    percent = share_percent(F.col("total_changes"), F.col("all_changes"))
    return counts.join(sessions, "session_id").select(
        *USER,
        "total_changes",
        percent.alias("engagement_percent"),
        bar(percent).alias("bar"),
        padded_bar(percent).alias("panel_bar"),
    )


def _winner(rows: DataFrame, by: list[str], measure: str, keep: list[str]) -> DataFrame:
    """The row with the largest measure; of equals the smallest user id."""
    best = F.max_by(F.struct("user", *keep), F.struct(F.col(measure), -F.col("user"))).alias("best")
    return rows.groupBy(*by).agg(best).select(*by, "best.*")


def most_active_user(events: DataFrame) -> DataFrame:
    return _winner(_user_counts(events), ["session_id"], "total_changes", ["total_changes"])


def most_responsive_user(events: DataFrame) -> DataFrame:
    rates = user_change_counts(events)
    return _winner(rates, ["session_id"], "changes_per_minute", ["changes_per_minute"])


def most_dominant_user(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """Per shared parameter that the session has: who owned it longest, for how long."""
    control = time_in_control(events, settings)
    return _winner(control, ["session_id", "param"], "control_seconds", ["control_seconds", "control_percent"])

"""Who and what takes part in a session: bounds, users, parameters, change counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tugboard.config import DEFAULTS, PanelSettings
from tugboard.functions.cells import per_minute, share_percent
from tugboard.functions.clock import tick_count, tick_step
from tugboard.plans.memo import recall, remembered
from tugboard.session import ensure_checkpoint_dir

SERIES = ["session_id", "user", "param"]


def change_counts(events: DataFrame, keep: bool = False) -> DataFrame:
    """Number, first and last time of the changes of each (session, user, parameter) that occurs.

    One pass over four columns of the events, combined before the shuffle. Session bounds, users,
    parameters and all coarser counts are made from this small table, and the sizes that decide how
    groups are laid out. ``keep`` writes it to the checkpoint folder, once per ``events`` frame, for
    operators that use it several times.
    """
    kept = recall(events, "change_counts")
    if kept is not None:
        return kept
    counts = events.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("changes"),
        F.min("time_sec").alias("first_time"),
        F.max("time_sec").alias("last_time"),
    )
    if not keep:
        return counts
    ensure_checkpoint_dir(events.sparkSession)
    return remembered(events, "change_counts", counts.checkpoint)


def session_bounds(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """One row per session: first and last time, duration, tick step and number of ticks.

    The grid is half open, so the last event normally lies beyond it; with one instant it is empty.
    """
    span = change_counts(events).groupBy("session_id").agg(
        F.min("first_time").alias("t_min"), F.max("last_time").alias("t_max")
    )
    return span.select(
        "session_id",
        "t_min",
        "t_max",
        (F.col("t_max") - F.col("t_min")).alias("duration"),
        tick_step(F.col("t_min"), settings.tick).alias("step"),
        tick_count(F.col("t_min"), F.col("t_max"), settings.tick).alias("n_ticks"),
    )


def distinct_users(events: DataFrame) -> DataFrame:
    return events.select("session_id", "user").distinct()


def distinct_params(events: DataFrame) -> DataFrame:
    """The parameters of each session, numbered in the order of their first change."""
    first = change_counts(events).groupBy("session_id", "param").agg(
        F.min(F.struct("first_time", "user")).alias("seen")
    )
    order = Window.partitionBy("session_id").orderBy("seen", "param")
    return first.select(
        "session_id",
        "param",
        "seen.first_time",
        F.row_number().over(order).cast("long").alias("position"),
    )


def parse_summary(events: DataFrame) -> DataFrame:
    """Number of changes, users and parameters per session."""
    return change_counts(events).groupBy("session_id").agg(
        F.sum("changes").alias("n_changes"),
        F.count_distinct("user").alias("n_users"),
        F.count_distinct("param").alias("n_params"),
    )


def users_by_params(counts: DataFrame, params: Sequence[str] | None = None) -> DataFrame:
    """Every user of a session with every parameter of that session, also where there is no change.

    With the number of changes, and the user's total over all parameters.
    """
    users = counts.groupBy("session_id", "user").agg(F.sum("changes").alias("total"))
    listed = counts.select("session_id", "param").distinct()
    if params is not None:
        listed = listed.where(F.col("param").isin(*params))
    return (
        users.join(listed, "session_id")
        .join(counts.select(*SERIES, "changes"), SERIES, "left")
        .select(*SERIES, F.coalesce("changes", F.lit(0)).alias("changes"), "total")
    )


def user_totals(events: DataFrame) -> DataFrame:
    """Changes, first and last action of each user, with the duration of the session."""
    users = change_counts(events, keep=True).groupBy("session_id", "user").agg(
        F.sum("changes").alias("total_changes"),
        F.min("first_time").alias("first_action_time"),
        F.max("last_time").alias("last_action_time"),
    )
    sessions = session_bounds(events).select("session_id", "duration")
    return users.join(sessions, "session_id")


def user_change_counts(events: DataFrame) -> DataFrame:
    """Changes per user and their rate per minute of the whole session."""
    return user_totals(events).select(
        "session_id",
        "user",
        "total_changes",
        per_minute(F.col("total_changes"), F.col("duration")).alias("changes_per_minute"),
    )


def param_change_counts(events: DataFrame) -> DataFrame:
    """Changes per user and parameter, zeros included, and their share of the user's changes."""
    percent = share_percent(F.col("changes"), F.col("total"))
    return users_by_params(change_counts(events, keep=True)).select(
        *SERIES, "changes", percent.alias("share_percent")
    )

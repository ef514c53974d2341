"""The tables behind the session report."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tugboard.config import DEFAULTS, PanelSettings
from tugboard.functions.cells import fixed, share_percent, title_case
from tugboard.operators.activity import (
    SERIES,
    USER,
    activity_record,
    control_seconds,
    engagement_distribution,
    most_active_user,
    most_dominant_user,
    most_responsive_user,
    owned_ticks,
    time_in_control,
)
from tugboard.operators.carefulness import NO_DATA, carefulness, judged, step_measures, summarise_carefulness
from tugboard.operators.roster import change_counts, session_bounds, users_by_params


def session_overview(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """Duration in seconds and minutes, and the parameters of each session in name order."""
    # One name per parameter of the session.
    counts = change_counts(events, keep=True)
    names = counts.select("session_id", "param").distinct().groupBy("session_id").agg(
        F.array_join(F.array_sort(F.collect_list(title_case(F.col("param")))), ", ").alias("params")
    )
    return session_bounds(events, settings).join(names, "session_id").select(
        "session_id", F.col("duration").alias("seconds"), (F.col("duration") / 60).alias("minutes"), "params"
    )


def session_report(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """One row per user and parameter: the user's activity with counts, control and carefulness."""
    counts = change_counts(events, keep=True)
    people = activity_record(events, settings).withColumn("active_minutes", F.col("active_duration") / 60)
    measured = (
        users_by_params(counts)
        .join(owned_ticks(events, settings), SERIES, "left")
        .join(step_measures(events, counts, settings), SERIES, "left")
    )
    seconds = control_seconds(settings)
    return (
        judged(measured, settings)
        .join(session_bounds(events, settings).select("session_id", "duration"), "session_id")
        .select(
            *SERIES,
            "changes",
            share_percent(F.col("changes"), F.col("total")).alias("share_percent"),
            seconds.alias("control_seconds"),
            F.when(seconds.isNotNull(), share_percent(seconds, F.col("duration"))).alias("control_percent"),
            "avg_step",
            "max_step",
            "careful_ratio",
            "behavior_type",
            title_case(F.col("param")).alias("param_label"),
        )
        .join(people, USER)
    )


def stats_panel(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """One compact line per user: changes, rate, share of control per shared parameter, longest gap."""
    control = time_in_control(events, settings)
    share = F.concat(
        title_case(F.col("param")), F.lit(" dominance: "), fixed(F.col("control_percent"), 1), F.lit("%")
    )
    # One entry per shared parameter.
    shares = control.groupBy(*USER).agg(
        F.array_sort(F.collect_list(F.struct("param", share.alias("cell")))).alias("cells")
    )
    line = F.concat_ws(
        "  |  ",
        F.concat(F.lit("User "), F.col("user"), F.lit(": "), F.col("total_changes"), F.lit(" changes")),
        F.concat(fixed(F.col("changes_per_minute"), 1), F.lit(" chg/min")),
        F.transform(F.coalesce("cells", F.array()), lambda c: c["cell"]),
        F.concat(F.lit("Max gap: "), fixed(F.col("max_inactivity_gap"), 1), F.lit("s")),
    )
    return activity_record(events, settings).join(shares, USER, "left").select(*USER, line.alias("line"))


def carefulness_report(
    events: DataFrame, settings: PanelSettings = DEFAULTS, user: int | None = None
) -> DataFrame:
    """Carefulness per parameter with the summary of its user, for all users or one."""
    measures = carefulness(events, settings, None if user is None else [user])
    return measures.join(summarise_carefulness(measures, settings), USER).withColumn(
        "param_label", title_case(F.col("param"))
    )


def carefulness_lines(report: DataFrame) -> DataFrame:
    """The rows of the carefulness report as text."""
    judged = F.concat_ws(
        " | ",
        F.concat(F.lit("Avg Δ="), fixed(F.col("avg_step"), 3)),
        F.concat(F.lit("Max Δ="), fixed(F.col("max_step"), 3)),
        F.concat(F.lit("Careful Steps="), fixed(F.col("careful_ratio"), 1), F.lit("%")),
        F.concat(F.lit("Behavior="), F.col("behavior_type")),
    )
    return report.select(
        *SERIES, F.when(F.col("avg_step").isNull(), F.lit(NO_DATA)).otherwise(judged).alias("line")
    )


def comparative_report(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """One row per user and shared parameter: share of all changes, carefulness, and the winners of the session.

    ``dominant_param`` is null in sessions where no shared parameter was set.
    """
    dominant = most_dominant_user(events, settings).where(F.col("param").isin(*settings.shared_params)).select(
        "session_id",
        F.col("param").alias("dominant_param"),
        F.col("user").alias("dominant_user"),
        F.col("control_seconds").alias("dominant_seconds"),
        F.col("control_percent").alias("dominant_percent"),
    )
    active = most_active_user(events).select(
        "session_id", F.col("user").alias("most_active_user"), F.col("total_changes").alias("most_changes")
    )
    responsive = most_responsive_user(events).select(
        "session_id",
        F.col("user").alias("most_responsive_user"),
        F.col("changes_per_minute").alias("best_rate"),
    )
    care = summarise_carefulness(carefulness(events, settings), settings)
    return (
        engagement_distribution(events)
        .join(care, USER)
        .join(active, "session_id")
        .join(responsive, "session_id")
        .join(dominant, "session_id", "left")
    )

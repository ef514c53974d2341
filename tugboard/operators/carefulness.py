"""Small steps or big jumps: how carefully each user moved each parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tugboard.config import DEFAULTS, LINE, PanelSettings
from tugboard.operators.roster import change_counts, users_by_params
from tugboard.plans.ordered import order_groups

# The labels.
CAREFUL = "Careful"
RECKLESS = "Reckless"
NO_VARIATION = "Careful (no variation)"
NO_DATA = "Insufficient data"

SERIES = ["session_id", "user", "param"]


def step_measures(events: DataFrame, counts: DataFrame, settings: PanelSettings) -> DataFrame:
    """Steps of every user and parameter with at least two values."""
    rows = events.select(*SERIES, "time_sec", *LINE, "value")
    ordered = order_groups(rows, SERIES, ["time_sec", *LINE], settings, counts)
    steps = (
        ordered.previous(before="value")
        .whole(lowest=("min", "value"), highest=("max", "value"))
        .done()
        .where(F.col("before").isNotNull())
        .withColumn("step", F.abs(F.col("value") - F.col("before")))
    )
    small = F.col("step") <= settings.small_step * (F.col("highest") - F.col("lowest"))
    return steps.groupBy(*SERIES).agg(
        F.avg("step").alias("avg_step"),
        F.max("step").alias("max_step"),
        F.count_if(small).alias("small_steps"),
        F.count(F.lit(1)).alias("steps"),
    )


def judged(measured: DataFrame, settings: PanelSettings) -> DataFrame:
    """Percent of small steps and label from the step measures, which are NULL without two values."""
    moved = F.col("max_step") > 0
    ratio = F.when(moved, F.col("small_steps").cast("double") / F.col("steps") * 100).when(~moved, F.lit(0.0))
    label = (
        F.when(F.col("max_step").isNull(), NO_DATA)
        .when(~moved, NO_VARIATION)
        .when(F.col("careful_ratio") > settings.careful_percent, CAREFUL)
        .otherwise(RECKLESS)
    )
    return measured.withColumn("careful_ratio", ratio).withColumn("behavior_type", label).drop("small_steps", "steps")


def carefulness(
    events: DataFrame, settings: PanelSettings = DEFAULTS, users: Sequence[int] | None = None
) -> DataFrame:
    """Mean and largest step, percent of small steps and label, for every user and parameter.

    A step is small up to a tenth of the range the user covered. Without two values there is nothing
    to judge; without any variation all measures are 0.
    """
    counts = change_counts(events, keep=True)
    grid = users_by_params(counts)
    if users is not None:
        chosen = F.col("user").isin(*users) if users else F.lit(False)
        grid, events = grid.where(chosen), events.where(chosen)
    return judged(grid.select(*SERIES).join(step_measures(events, counts, settings), SERIES, "left"), settings)


def summarise_carefulness(measures: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    usable = F.col("behavior_type") != NO_DATA
    is_careful = F.col("behavior_type").isin(CAREFUL, NO_VARIATION).cast("double")
    percent = F.avg(F.when(usable, is_careful)) * 100
    label = (
        F.when(F.col("careful_percent").isNull(), NO_DATA)
        .when(F.col("careful_percent") >= settings.careful_percent, CAREFUL)
        .otherwise(RECKLESS)
    )
    return (
        measures.groupBy("session_id", "user").agg(percent.alias("careful_percent"))
        .withColumn("label", label)
    )


def carefulness_summary(
    events: DataFrame, settings: PanelSettings = DEFAULTS, skip_without_data: bool = False
) -> DataFrame:
    """Per user: percent of the judged parameters that were moved carefully, and the label.

    Users without a judged parameter are labelled so, or left out with ``skip_without_data``.
    """
    summary = summarise_carefulness(carefulness(events, settings), settings)
    return summary.where(F.col("careful_percent").isNotNull()) if skip_without_data else summary

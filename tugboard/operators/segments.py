"""Value-change segments: from which value to which, between which times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tugboard.config import DEFAULTS, LINE, PanelSettings
from tugboard.operators.roster import change_counts
from tugboard.plans.ordered import order_groups


def change_segments(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """Where consecutive values of one (user, parameter) differ, in the order of the time text.

    A segment starts at the event right before the change, also if that one changed nothing.
    """
    keys = ["session_id", "user", "param"]
    ordered = order_groups(
        events.select(*keys, "time", *LINE, "value"), keys, ["time", *LINE], settings, change_counts(events)
    )
    return (
        ordered.previous(start_time="time", from_value="value").done()
        .where(F.col("value") != F.col("from_value"))
        .select(*keys, "start_time", F.col("time").alias("end_time"), "from_value", F.col("value").alias("to_value"))
    )


def change_segments_preview(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """The first rows of the sorted segments."""
    segments = change_segments(events, settings)
    order = ["session_id", "user", "param", "end_time", "start_time", "from_value", "to_value"]
    return segments.orderBy(*order).limit(settings.preview_rows)

"""The two sizes most layout decisions need, from one job over the table of change counts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tugboard.plans.memo import remembered


class SessionSizes(NamedTuple):
    sessions: int
    largest: int  # changes of the largest session; no group within a session has more


def session_sizes(counts: DataFrame) -> SessionSizes:
    def measure() -> SessionSizes:
        per_session = counts.groupBy("session_id").agg(F.sum("changes").alias("n"))
        row = per_session.agg(F.count(F.lit(1)), F.max("n")).first()
        return SessionSizes(row[0], row[1] or 0)

    return remembered(counts, "session_sizes", measure)

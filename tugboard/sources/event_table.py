"""An events table read as panel sessions.

Four consecutive user ids share a panel: the panel is the session, the seat at it is the user, the
event type is the parameter. Times are seconds since 1970, so thresholds have to be rescaled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tugboard.sources.control_logs import EVENT_COLUMNS

SEATS = 4


def _epoch_seconds(kind: str) -> Column:
    """Seconds since 1970 with microseconds; wall-clock time counts as UTC in every session zone."""
    if kind == "timestamp":
        return F.unix_micros("ts").cast("double") / 1e6
    minutes = F.expr("unix_date(cast(ts as date)) * 1440L + hour(ts) * 60 + minute(ts)")
    micros = F.expr("cast(extract(second from ts) * 1000000 as bigint)")
    return (minutes * 60_000_000 + micros).cast("double") / 1e6


def read_event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    panel = F.expr(f"cast(user_id div {SEATS} as string)")
    return (
        raw.where(F.col("value").isNotNull() & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
        .withColumns({
            "session_id": F.concat(F.lit("panel-"), panel),
            "file": F.concat(F.lit("User"), (F.col("user_id") % SEATS).cast("string"), F.lit(".log")),
            "block_start": F.lit(0).cast("long"),
            "mid": F.col("event_id"),
            "time": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
            "user": (F.col("user_id") % SEATS).cast("int"),
            "param": F.col("event_type"),
            "time_sec": _epoch_seconds(dict(raw.dtypes)["ts"]),
        })
        .select(*EVENT_COLUMNS)
    )

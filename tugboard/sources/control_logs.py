"""Control logs: one line per change, many files named after the user who wrote them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tugboard.config import LINE
from tugboard.functions.clock import seconds_of_day
from tugboard.sources.lines import read_lines, require_rows

# The file names and the two line formats.
LOG_GLOB = "User*.log"
USER_IN_NAME = r"User(\d+)"
LENIENT_LINE = (
    r"(?id)(\d{2}:\d{2}:\d{2}\.\d+).*?(?:User\s*(\d+))?\s*sets\s+([a-z ]+?)\s+to\s+([-+]?\d*\.?\d+)"
)
STRICT_LINE = r"(?id)(\d{2}:\d{2}:\d{2}\.\d+).*?(?:User\s*(\d+))?\s*sets\s+([a-z ]+)\s+to\s+([-\d.]+)"

EVENT_COLUMNS = ("session_id", *LINE, "time", "user", "param", "value", "time_sec")


def read_control_logs(
    spark: SparkSession, folder: str, glob: str = LOG_GLOB, session: Column | None = None, **options: str
) -> DataFrame:
    """Raw lines of every matching file below ``folder``."""
    return read_lines(spark, folder, glob, session, **options)


def _matched(lines: DataFrame, pattern: str) -> DataFrame:
    """The four groups of the first hit of each line that has one.

    One replacement fetches all groups, so the expression runs once per line. It sits in a generator
    because a filter on its result would otherwise be pushed below it and run it again.
    """
    flags, bare = pattern[:5], pattern[5:]
    groups = F.split(F.regexp_replace("line", f"{flags}^.*?{bare}.*$", "$1\n$2\n$3\n$4"), "\n")
    name = F.element_at(F.split("file", "/"), -1)
    hits = lines.select("*", F.explode(F.array(groups)).alias("groups")).where(F.size("groups") == 4)
    return hits.select(
        "session_id",
        *LINE,
        "line",
        F.col("groups")[0].alias("time"),
        F.col("groups")[1].alias("user_text"),
        F.trim(F.col("groups")[2]).alias("param_text"),
        F.col("groups")[3].alias("value_text"),
        F.regexp_extract(name, USER_IN_NAME, 1).alias("file_user"),
    ).select(
        "*",
        F.expr("try_cast(if(user_text != '', user_text, file_user) as bigint)").alias("user"),
        F.expr("try_cast(value_text as double)").alias("value"),
    )


def _usable() -> Column:
    return F.col("user").isNotNull() & F.col("value").isNotNull()


def _events(matched: DataFrame, param: Column, fail_fast: bool) -> DataFrame:
    if fail_fast:
        message = F.concat(F.lit("unreadable change: "), F.col("line"))
        matched = matched.withColumn(
            "value", F.when(_usable(), F.col("value")).otherwise(F.raise_error(message).cast("double"))
        )
    return (
        matched.where(_usable())
        .withColumns({"param": param, "time_sec": seconds_of_day(F.col("time"))})
        .select(*EVENT_COLUMNS)
    )


def parse_control_events(
    lines: DataFrame, fail_fast: bool = False, require_nonempty: bool = False
) -> DataFrame:
    """Lenient reading: first hit per line, parameter lower-cased, the file's user where none is named.

    Lines without a hit are dropped. A hit without a usable user goes to ``rejected_lines``, or
    raises with ``fail_fast``.
    """
    events = _events(_matched(lines, LENIENT_LINE), F.lower("param_text"), fail_fast)
    return require_rows(events, "parameter changes") if require_nonempty else events


def parse_control_events_strict(
    lines: DataFrame, fail_fast: bool = False, require_nonempty: bool = False
) -> DataFrame:
    """Strict reading: parameter case kept, no plus sign, and any run of digits, dots and minus signs
    is taken as the value. Where that is no number the line is rejected, or raises with ``fail_fast``.
    """
    events = _events(_matched(lines, STRICT_LINE), F.col("param_text"), fail_fast)
    return require_rows(events, "parameter changes") if require_nonempty else events


def rejected_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Lines that match the format but carry no usable user or value."""
    matched = _matched(lines, STRICT_LINE if strict else LENIENT_LINE)
    return matched.where(~_usable()).select("session_id", *LINE, "line", "user_text", "value_text")

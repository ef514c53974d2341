"""Text files as rows that still know their place: file, split and running number in the split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_BYTES = 32 << 20   # of files too small to be tasks of their own, what one task reads
TASKS_A_CORE = 8        # or that many tasks, if that is more


def read_lines(
    spark: SparkSession, folder: str, glob: str, session: Column | None = None, **options: str
) -> DataFrame:
    """``session_id, file, block_start, mid, line``; ordering by the middle three restores line order.

    Large files stay splittable. The key is taken on the scan itself, before anything moves a row.
    """
    found = spark.read.options(pathGlobFilter=glob, **options).text(folder)
    lines = found.select(
        (session if session is not None else F.lit("all")).alias("session_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("mid"),
        F.col("value").alias("line"),
    )
    return _fewer_tasks(lines, found)


def _fewer_tasks(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``lines`` with several of the scan's splits in a task where most hold a few small files.

    Spark counts a file as four megabytes at least, so that many small logs would make a task, and later a file of
    results, of every few of them. No row moves, and the number of a line is that of its split still.
    """
    size = int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(math.ceil(size / TASK_BYTES), TASKS_A_CORE * found.sparkSession.sparkContext.defaultParallelism)
    return lines.coalesce(tasks) if found.rdd.getNumPartitions() > tasks else lines


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    """The fail-on-empty policy; without it an empty input gives an empty table of the same schema."""
    if rows.isEmpty():
        raise ValueError(f"no {what} found")
    return rows

"""Log text that Spark writes out of the events table, so that the parsers have whole tables to read."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tugboard.session import ensure_checkpoint_dir
from tugboard.sources.control_logs import read_control_logs
from tugboard.sources.event_table import SEATS
from tugboard.sources.imu_logs import read_imu_logs

EVENTS_PER_BLOCK = 64
SHELVES = 256   # folders that the folders of sessions are dealt to: Spark lists each in a task


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        "event_type",
        F.concat(F.lit("panel-"), F.expr(f"cast(user_id div {SEATS} as string)")).alias("session_id"),
        (F.col("user_id") % SEATS).cast("string").alias("user"),
        F.date_format("ts", "HH:mm:ss.SSSSSS").alias("time"),
        F.col("value").cast("string").alias("value"),
    )


def control_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per event, in eight spellings by event id: well-formed, borderline and broken."""
    time, user, param, value = (F.col(c) for c in ("time", "user", "event_type", "value"))

    def line(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    spelling = F.col("event_id") % 8
    text = (
        F.when(spelling == 0, line(time, " User ", user, " sets ", F.initcap(param), " to ", value, "."))
        .when(spelling == 1, line(time, " sets ", param, " level to -", value))
        .when(spelling == 2, line(time, " User 9 resets ", param, " to +", value))
        .when(spelling == 3, line(time, " [panel] user", user, "SETS ", F.upper(param), "  to ", value, " and User 9 sets gain to 1"))
        .when(spelling == 4, line("heartbeat ", time, " ", param))
        .when(spelling == 5, line(F.left(time, F.lit(8)), " User ", user, " sets ", param, " to ", value))
        .when(spelling == 6, line(time, " User ", user, " sets ", param, " step to fast to ", value))
        .otherwise(line(time, " User ", user, " sets ", param, " to ", value))
    )
    return _raw(spark, sf_dir).select(
        "session_id",
        F.concat(F.col("session_id"), F.lit("/User"), user, F.lit(".log")).alias("file"),
        F.expr(f"event_id div {EVENTS_PER_BLOCK}").alias("block_start"),
        F.col("event_id").alias("mid"),
        text.alias("line"),
    )


def imu_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of several lines per event; some lack a sensor, some have a malformed reading."""
    value, number = F.col("value"), F.col("event_id")

    def reading(name: str, offset: int, axes: str) -> str:
        return f"{name} = SensorInfo {{ Timestamp = %d, Accuracy = {offset % 4}, Data = {axes} }}"

    def text(template: str, *args: Column) -> Column:
        """What ``format_string`` gives, which takes a formatter's run for each line."""
        between = [F.lit(part) for part in re.split("%[sd]", template)]
        shown = [F.coalesce(arg.cast("string"), F.lit("null")) for arg in args]
        return F.concat(*[part for pair in zip(between, shown) for part in pair], between[-1])

    broken = number % 10
    gyro_x = F.when(broken == 5, F.lit("1E-4")).when(broken == 9, F.lit("1.2.3")).otherwise(value)
    lines = F.array(
        F.when(broken == 7, F.concat(F.col("time"), F.lit(" boot"))).otherwise(F.lit("# record")),
        F.concat(F.col("time"), F.lit(" "), text(reading("Gyroscope", 3, "<%s, -%s, 0.5>"), number * 5, gyro_x, value)),
        text(reading("Accelerometer", 2, "<0.0, %s, -9.8>"), number * 5 + 1, value),
        text(reading("MagneticField", 1, "<%s, 1, 41.0>"), number * 5 + 2, value),
        F.when(broken == 3, F.lit("sensor missing")).otherwise(
            text(reading("Gravity", 3, "<0.0, 9.8, %s>"), number * 5 + 3, value)
        ),
        text(reading("Rotation", 2, "{X:0.0 Y:%s Z:-0.2 W:0.9}"), number * 5 + 4, value),
    )
    return _raw(spark, sf_dir).select(
        "session_id",
        F.concat(F.col("session_id"), F.lit("/imu_log.txt")).alias("file"),
        F.expr(f"event_id div {EVENTS_PER_BLOCK}").alias("block_start"),
        number,
        F.posexplode(lines).alias("k", "line"),
    ).select("session_id", "file", "block_start", (F.col("event_id") * 8 + F.col("k")).alias("mid"), "line")


# Folders of log files by session, table folder and kind: the files are the parsers' input, and are written once.
_folders: dict[tuple[str, str, str], str] = {}


def _log_writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes rows of ``log, text``, in the order of logs, as one file per log below ``folder``; gives their number."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, root = fs.FileSystem.from_uri(folder)
        current, stream, part, files = None, None, None, 0

        def end() -> None:
            if stream is not None:
                stream.close()
                shared.move(part, f"{root}/{current}")   # under its name once it is whole: a task may run twice

        for batch in batches:
            logs, begin = pc.run_end_encode(batch["log"]), 0
            _, offsets, data = batch["text"].buffers()
            at = np.frombuffer(offsets, np.int32)[batch["text"].offset:]
            for log, upto in zip(logs.values.to_pylist(), logs.run_ends.to_pylist()):
                if log != current:
                    end()
                    current, files = log, files + 1
                    session = f"{root}/{log.rpartition('/')[0]}"
                    shared.create_dir(session)
                    part = f"{session}/_{uuid.uuid4()}"
                    stream = shared.open_output_stream(part)
                stream.write(data.slice(int(at[begin]), int(at[upto] - at[begin])))   # texts lie one behind the other
                begin = upto
        end()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    return write


def _log_files(spark: SparkSession, sf_dir: str, kind: str, lines: DataFrame) -> str:
    """The folder of ``lines`` as text files ``<shelf>/<session>/<name>`` in the shared folder; the writer of a log does not use Spark.

    Each task writes the logs it holds. Spark's own writer makes a folder per log, which the driver would list and rename
    one by one; there are as many logs as users.
    """
    known = (spark.sparkContext.applicationId, sf_dir, kind)
    if known not in _folders:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/logs-{uuid.uuid4()}"
        folder = re.sub("^file:/+", "file:///", folder)
        shared, root = fs.FileSystem.from_uri(folder)
        shared.create_dir(root)   # also for no lines
        shelf = F.pmod(F.xxhash64("session_id"), F.lit(SHELVES)).cast("string")
        log = F.concat(shelf, F.lit("/session_id="), "session_id", F.lit("/"), F.element_at(F.split("file", "/"), -1))
        named = lines.select(log.alias("log"), "block_start", "mid", "line").where(F.col("log").isNotNull())
        text = F.concat(F.coalesce("line", F.lit("")), F.lit("\n")).cast("binary").alias("text")
        made = named.repartition("log").sortWithinPartitions("log", "block_start", "mid").select("log", text)
        made.mapInArrow(_log_writer(folder), "files long").agg(F.sum("files")).first()
        _folders[known] = folder
    return _folders[known]


def _session() -> Column:
    return F.substring_index(F.substring_index("_metadata.file_path", "/session_id=", -1), "/", 1)


def _short_names(lines: DataFrame) -> DataFrame:
    return lines.withColumn("file", F.concat("session_id", F.lit("/"), F.substring_index("file", "/", -1)))


def control_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of ``control_lines``, read from log files named after their users."""
    folder = _log_files(spark, sf_dir, "control", control_lines(spark, sf_dir))
    return _short_names(read_control_logs(spark, folder, session=_session(), recursiveFileLookup="true"))


def imu_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of ``imu_lines``, read from one sensor log per session."""
    folder = _log_files(spark, sf_dir, "imu", imu_lines(spark, sf_dir))
    return _short_names(read_imu_logs(spark, folder, session=_session(), recursiveFileLookup="true"))

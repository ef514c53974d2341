"""Events kept for many readings: laid out by session and by blocks of time, with the state at each border.

The events lie in Parquet files by block of time and, within a block, by hash of the session. A reader that
keeps this layout needs no shuffle before windows and aggregates per session, and one that wants a stretch of time
opens its blocks only. What every series last held before a block began is a table of its own, so nobody has to read
the history to know where a stretch starts.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tugboard.config import LINE
from tugboard.operators.roster import SERIES, change_counts
from tugboard.plans.memo import remembered
from tugboard.sources.control_logs import EVENT_COLUMNS

STATE_COLUMNS = [*SERIES, "time_sec", *LINE, "value"]


@dataclass(frozen=True)
class SessionStore:
    events: DataFrame     # as they were written, and ``block``
    states: DataFrame     # STATE_COLUMNS of the last change of each series before ``block`` began
    counts: DataFrame     # the table of change counts
    block_seconds: float

    def between(self, first: float, last: float) -> DataFrame:
        """The events of all blocks that meet the closed stretch; sizes and bounds are those of the whole store."""
        near = self.events.where(F.col("block").between(int(first // self.block_seconds), int(last // self.block_seconds)))
        remembered(near, "change_counts", lambda: self.counts)
        return near

    def states_at(self, time: float) -> DataFrame:
        """The state of every series at the beginning of the block that ``time`` lies in."""
        return self.states.where(F.col("block") == int(time // self.block_seconds)).drop("block")


def _save(rows: DataFrame, path: str, buckets: int) -> None:
    """One file for each block and hash of sessions, so a large session is spread over its blocks."""
    dealt = rows.repartition("block", F.pmod(F.hash("session_id"), F.lit(buckets)))
    name = f"store_{uuid.uuid4().hex}"
    writer = dealt.write.format("parquet").partitionBy("block").bucketBy(buckets, "session_id").option("path", path)
    writer.saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")   # the files stay


def _block_states(events: DataFrame) -> DataFrame:
    """The last change of each series before each block, up to the last block of its session."""
    rest = [c for c in STATE_COLUMNS if c not in SERIES]
    last = events.groupBy(*SERIES, "block").agg(F.max_by(F.struct(*rest), F.struct("time_sec", *LINE)).alias("last"))
    ends = events.groupBy("session_id").agg(F.max("block").alias("final"))
    following = F.lead("block").over(Window.partitionBy(*SERIES).orderBy("block"))
    held = last.withColumn("following", following).join(ends, "session_id")
    until = F.coalesce("following", "final")
    return held.where(until > F.col("block")).select(
        *SERIES, "last.*", F.explode(F.sequence(F.col("block") + 1, until)).alias("block")
    )


def write_session_store(events: DataFrame, path: str, block_seconds: float, buckets: int = 64) -> None:
    """``events`` below the folder ``path``, which must not exist. A table without events gives an empty store."""
    blocked = events.select(*EVENT_COLUMNS, F.floor(F.col("time_sec") / block_seconds).alias("block"))
    _save(blocked, f"{path}/events", buckets)
    stored = events.sparkSession.read.schema(blocked.schema).parquet(f"{path}/events")
    _save(_block_states(stored), f"{path}/states", buckets)
    change_counts(events).write.parquet(f"{path}/counts")
    about = [(block_seconds, buckets, events.select(*EVENT_COLUMNS).schema.json())]
    events.sparkSession.createDataFrame(about, "block_seconds double, buckets int, event_schema string").write.parquet(f"{path}/about")


def _table(spark: SparkSession, path: str, columns: str, buckets: int) -> DataFrame:
    """The files below ``path`` as a table that knows its layout. The name lives as long as the Spark session's catalog."""
    name = f"store_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({columns}, block BIGINT) USING parquet PARTITIONED BY (block) "
        f"CLUSTERED BY (session_id) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def read_session_store(spark: SparkSession, path: str) -> SessionStore:
    """The store below ``path``, with its layout."""
    about = spark.read.parquet(f"{path}/about").first()
    kinds = {field.name: field.dataType.simpleString() for field in StructType.fromJson(json.loads(about.event_schema)).fields}
    events, states = (
        _table(spark, f"{path}/{part}", ", ".join(f"`{c}` {kinds[c]}" for c in columns), about.buckets)
        for part, columns in (("events", EVENT_COLUMNS), ("states", STATE_COLUMNS))
    )
    counts = spark.read.parquet(f"{path}/counts")
    remembered(events, "change_counts", lambda: counts)
    return SessionStore(events, states, counts, about.block_seconds)

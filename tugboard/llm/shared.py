"""What several of these operators need: free column names, texts as byte buffers, stored tables."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

from tugboard.session import ensure_checkpoint_dir

SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each behind so many underscores that no column of ``taken`` has it, in any case."""
    used = {name.lower() for name in taken}
    found = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        found.append(name)
    return found


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hand rows to Python in small Arrow batches: a batch of long texts must fit in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def widened(frame: DataFrame, **added: DataType) -> StructType:
    """The schema of ``frame`` with more columns at its end."""
    return StructType([*frame.schema.fields, *[StructField(name, kind) for name, kind in added.items()]])


def stored(frame: DataFrame, *partition_by: str, free: bool = False) -> DataFrame:
    """``frame`` as a Parquet table in the shared checkpoint folder: columnar, compressed, and cut from its lineage.

    ``free``: once it is written, nothing needs its shuffle files any more, and Spark removes them.
    """
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    writer = frame.write.option("compression", "zstd")
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true" if free else before)
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch, one after another, and where each begins; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(offsets, width)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0]: starts[-1]], starts - starts[0]


def texts(column: pa.Array) -> list[bytes]:
    """Each text of a batch as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... of all runs, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def worker_state() -> dict:
    """A dict that lives as long as the Python worker, over tasks; functions that travel by value have no other."""
    if "_tugboard_worker" not in sys.modules:
        sys.modules["_tugboard_worker"] = types.ModuleType("_tugboard_worker")
    return sys.modules["_tugboard_worker"].__dict__.setdefault("state", {})

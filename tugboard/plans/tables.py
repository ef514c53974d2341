"""Results that are needed twice, as Parquet in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tugboard.session import ensure_checkpoint_dir


def written(frame: DataFrame, *partition_by: str) -> DataFrame:
    """``frame`` written down and cut from its lineage; readers take only the columns they need."""
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    frame.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)

"""Connected components of a table of links, by alternating stars.

Each round moves every node's larger neighbours to its smallest one (large star), then every node's
smaller neighbours to the smallest of them (small star), until nothing moves. The number of rounds
grows with the logarithm of the longest chain. Only two numbers per round reach the driver; the
links of a round are a checkpoint, so a lost executor repeats one round and not all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tugboard.session import ensure_checkpoint_dir


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    smallest = both.groupBy("high").agg(F.min("low").alias("least"))
    return (
        both.where("low > high").join(smallest, "high")
        .select(F.col("low").alias("high"), F.least("high", "least").alias("low"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    smallest = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(smallest, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(smallest.select("high", F.col("least").alias("low")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the smallest node reachable, for each node that occurs in a link to another one.

    ``links`` may hold a link twice, in both directions, or from a node to itself; null ends are ignored.
    """
    ensure_checkpoint_dir(links.sparkSession)
    now = (
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .distinct().checkpoint()
    )
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
                now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
            )
        before = state
        now = _small_star(_large_star(now)).distinct().checkpoint()

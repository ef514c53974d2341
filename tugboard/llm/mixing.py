"""Mixes sources to target weights: blocks, multinomial shards, permuted indices, one join by index.

Every source's words form one stream, cut into blocks of a fixed number of words. A source's target is
turned into a number of slots; a multinomial draw deals these out over the output shards, so each shard
holds all sources in about the target proportions while the totals come out exactly. The slots of a
source are numbered through all shards, and slot j takes the block at place j of a pseudorandom
permutation of the block numbers (a new one for each round through the source). What a document gives
is then found by joining the blocks taken with the blocks it lies in, by block number.

Everything drawn follows from the seed and the source's place in code point order, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tugboard.llm.shared import WORD, bounded_batches, fresh, stored


@dataclass(frozen=True)
class MixRule:
    weights: tuple[int, ...] = (5, 2, 1)  # of the sources in code point order, null last, repeating
    most_repeats: int = 3
    block_words: int = 64
    shards: int = 64                      # output shards; every source's slots are dealt out over all
    seed: int = 20
    fan_out: int = 256                    # parts in which a source's documents are put in order


def numbered(frame: DataFrame, name: str, *order: Column) -> DataFrame:
    """``frame``, which is written down, with the place of each row in a total order, from 0.

    Ranges of rows are numbered in parallel; only the number of rows of each range reaches the driver.
    """
    order_names = fresh(frame.columns, *[f"order{k}" for k in range(len(order))], "part", "start")
    keys, (part, start) = order_names[:-2], order_names[-2:]
    cut = frame.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys)
    cut = cut.withColumn(part, F.spark_partition_id()).checkpoint()
    counts = {r[part]: r["count"] for r in cut.groupBy(part).count().collect()}
    totals = np.cumsum([0, *[counts[p] for p in sorted(counts)]]).tolist()
    starts = frame.sparkSession.createDataFrame(list(zip(sorted(counts), totals, strict=False)), f"{part} int, {start} bigint")
    within = F.row_number().over(Window.partitionBy(part).orderBy(*keys))
    return cut.withColumn(name, within).join(F.broadcast(starts), part).select(
        *frame.columns, (F.col(start) + F.col(name) - 1).alias(name)
    )


def source_targets(sizes: DataFrame, rule: MixRule) -> DataFrame:
    """``source, source_no, source_size, weight, target`` from ``source, size``.

    The words are shared out by weight; where that is more than a source may repeat, the excess goes to
    the others by weight, round by round. A round needs three sums over the table of sources.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = numbered(sources, "source_no", F.col("source").isNull(), F.col("source"))
    choices = F.array(*[F.lit(w) for w in rule.weights])
    weighted = sources.withColumn("weight", F.get(choices, F.pmod("source_no", F.lit(len(rule.weights))).cast("int"))).checkpoint()
    most = F.col("source_size") * rule.most_repeats
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    rest, share, full = total, 0, F.lit(False)
    while True:
        sums = weighted.agg(
            F.sum(F.when(full, most).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.sum(full.cast("int"))
        ).first()
        if (sums[0] is None or sums[1] == 0) or (share and sums[2] == at_limit):
            break
        at_limit, rest, share = sums[2], total - sums[0], sums[1]
        full = F.col("weight") * F.lit(float(rest)) > most * F.lit(float(share))
    even = F.lit(float(rest)) * F.col("weight") / F.lit(float(share or 1))
    return weighted.withColumn("target", F.when(full, most.cast("double")).otherwise(even))


def permuted(index: np.ndarray, size: int, key: list[int]) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1, applied to ``index``: a Feistel network, walked until inside."""
    half = max(1, math.ceil(math.log2(max(2, size)) / 2))
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 2**63, 6, dtype=np.uint64)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        with np.errstate(over="ignore"):
            for k in keys:
                x = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((x >> np.uint64(33)) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def taken_blocks(sources: DataFrame, rule: MixRule) -> DataFrame:
    """``source_no, shard, slot, block``: the block behind every slot of every output shard."""
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, slots in zip(batch["source_no"], batch["slots"], strict=True):
                counts = np.random.default_rng([rule.seed, number]).multinomial(slots, [1 / rule.shards] * rule.shards)
                starts = np.cumsum(counts) - counts
                yield pd.DataFrame({"source_no": number, "shard": np.arange(rule.shards), "start": starts, "count": counts})

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                for begin in range(row.start, row.start + row.count, 100_000):
                    slot = np.arange(begin, min(begin + 100_000, row.start + row.count))
                    block = np.empty_like(slot)
                    for turn in np.unique(slot // row.blocks):
                        now = slot // row.blocks == turn
                        block[now] = permuted(slot[now] % row.blocks, row.blocks, [rule.seed, row.source_no, turn])
                    yield pd.DataFrame({"source_no": row.source_no, "shard": row.shard, "slot": slot, "block": block})

    plan = sources.where("slots > 0").select("source_no", "slots", "blocks")
    dealt = plan.select("source_no", "slots").mapInPandas(draw, "source_no bigint, shard int, start bigint, count bigint")
    parts = dealt.where("count > 0").join(plan.select("source_no", "blocks"), "source_no")
    return parts.repartition("source_no", "shard").mapInPandas(look_up, "source_no bigint, shard int, slot bigint, block bigint")


def mixture(sized: DataFrame, rule: MixRule) -> tuple[DataFrame, DataFrame]:
    """From ``row, id, source, size`` (``row`` is unique): the rows with their source's figures and their
    place in its stream of words, and the blocks they lie in with how often the mix takes each."""
    targets = source_targets(sized.select("source", "size"), rule)
    blocks = F.ceil(F.col("source_size") / rule.block_words)
    slots = F.when(blocks > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0).cast("bigint")
    sources = targets.withColumn("blocks", blocks).withColumn("slots", slots).checkpoint()
    parted = sized.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(rule.fan_out)).cast("int"))
    within = Window.partitionBy("source", "part").orderBy("id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per source and part: what comes before the part in the source's stream.
    starts = parted.groupBy("source", "part").agg(F.sum("size").alias("words")).select(
        F.col("source").alias("of"), F.col("part").alias("in"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start")
    ).join(sources, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    ordered = parted.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = ordered.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in"))).select(
        "row", "id", "size", "source_no", "source_size", "target", (F.col("start") + F.col("offset")).alias("offset")
    ).checkpoint()
    taken = taken_blocks(sources, rule).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    size, offset = rule.block_words, F.col("offset")
    first, last = F.floor(offset / size), F.floor((offset + F.col("size") - 1) / size)
    pieces = placed.where("size > 0").select("row", "size", "source_no", "offset", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * size, offset)
    end = F.least((F.col("block") + 1) * size, offset + F.col("size"))
    pieces = pieces.select("row", "source_no", "block", (begin - offset).alias("begin"), (end - begin).alias("words"))
    return placed, pieces.join(taken, ["source_no", "block"]).select("row", "begin", "words", "times")


def _sized(docs: DataFrame, id: str, text: str, source: str) -> list[Column]:
    return [
        F.monotonically_increasing_id().alias("row"), F.col(id).cast("bigint").alias("id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    ]


def mix_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", rule: MixRule = MixRule()) -> DataFrame:
    """``id, size, source_size, target, taken`` for every row: words it has, and words the mix takes of it.

    Null texts have no words and give none; a null source is the last one; rows that repeat are each
    their own; a table without rows gives none.
    """
    (name,) = fresh(["size", "source_size", "target", "taken"], id)
    sized = stored(docs.select(*_sized(docs, id, text, source)))
    placed, pieces = mixture(sized, rule)
    taken = pieces.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return placed.join(taken, "row", "left").select(
        F.col("id").alias(name), "size", "source_size", F.round("target", 6).alias("target"),
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
    )


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", rule: MixRule = MixRule()) -> DataFrame:
    """The mix as rows of ``docs``: a row for each time, whose text is what the mix takes of it that time.

    A text taken whole stays as it is. Of one taken in part the stretches taken are joined by line ends.
    Rows without words come out once, as they are.
    """
    whole, parts = fresh([*docs.columns, "row", "id", "source", "size"], "whole", "parts")
    kept = stored(docs.select(F.struct("*").alias(whole), *_sized(docs, id, text, source)))
    placed, pieces = mixture(kept.select("row", "id", "source", "size"), rule)
    taken = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("begin", "words", "times"))).alias(parts))
    joined = kept.select("row", whole, "size").join(taken, "row", "left").where((F.col("size") == 0) | F.col(parts).isNotNull())
    turns = F.explode(F.sequence(F.lit(1), F.coalesce(F.array_max(F.transform(parts, lambda x: x["times"])), F.lit(1)))).alias("turn")
    now = F.filter(parts, lambda x: x["times"] >= F.col("turn"))
    names = docs.columns
    at = names.index(text)
    rows = joined.select(whole, "size", parts, turns).select(
        *[F.col(f"{whole}.{name}").alias(f"c{k}") for k, name in enumerate(names)],
        F.col("size").alias("size"), F.transform(now, lambda x: x["begin"]).alias("begins"), F.transform(now, lambda x: x["words"]).alias("words"),
    )
    bounded_batches(docs.sparkSession)
    word = re.compile(WORD)

    def cut(body: str, size: int, begins: list[int] | None, words: list[int] | None) -> str:
        if not begins or sum(words) == size:
            return body
        spans = [m.span() for m in word.finditer(body)]
        runs: list[list[int]] = []
        for begin, count in zip(begins, words, strict=True):
            if runs and runs[-1][1] == begin:
                runs[-1][1] = begin + count
            else:
                runs.append([begin, begin + count])
        return "\n".join(body[spans[a][0]: spans[b - 1][1]] for a, b in runs)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            lists = [c.to_pylist() for c in (columns[at], *columns[len(names):])]
            columns[at] = pa.array([cut(*x) if x[0] else x[0] for x in zip(*lists, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns[:len(names)], names)

    return rows.mapInArrow(take, docs.schema)

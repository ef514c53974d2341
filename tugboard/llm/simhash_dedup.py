"""Groups documents whose SimHash fingerprints are close, by vantage-point trees over the fingerprints.

Two 64-bit fingerprints that differ in at most r bits differ in at most r // 4 bits in one of their
four 16-bit quarters at least. Each quarter has a vantage-point tree: on every level the distance to
that level's vantage point is compared with a radius, near ones go left and far ones right. A
fingerprint has one home leaf, and asks in every leaf that the triangle inequality cannot rule out:
within r // 4 of the radius it asks on both sides. The top levels are the shards that Spark deals out,
the lower levels are walked inside a task. What is met in a leaf is compared over all 64 bits, so the
pairs found are exact and complete.

Copies share a fingerprint and are one row from the start. A task keeps a spanning forest of the pairs
it meets, not the pairs, so a group of n near copies gives n links at most from each shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tugboard.llm.components import components
from tugboard.llm.shared import bounded_batches, fresh, texts
from tugboard.session import ensure_checkpoint_dir

QUARTERS = 4


@dataclass(frozen=True)
class SimhashRule:
    shingle_words: int = 4
    max_differing: int = 4       # bits, at most 15
    seed: int = 42
    shard_size: int = 20_000     # fingerprints aimed at per home leaf of a shard; decides the depth
    min_depth: int = 5
    max_depth: int = 10
    leaf_depth: int = 12         # levels of the whole tree, those walked inside a task included
    block_cells: int = 2_000_000


def fingerprint(body: bytes, words: int, seed: int) -> int:
    """Bit by bit the majority of the hashes of all runs of ``words`` words; 0 for a text without words."""
    parts = body.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    starts = [0, *accumulate(len(x) + 1 for x in parts)]
    last = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b - 1], seed) for a, b in zip(starts[:last], starts[min(words, len(parts)):], strict=False)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, id: str, text: str, rule: SimhashRule) -> DataFrame:
    """``id, print``, the print as a signed 64-bit number."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, rule.shingle_words, rule.seed) for x in texts(batch.column(1))]
            prints = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["id", "print"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(compute, "id bigint, print bigint")


def vantage_points(quarter: int, seed: int, levels: int) -> np.ndarray:
    return np.random.default_rng([seed, quarter]).integers(0, 1 << 16, levels, dtype=np.uint64)


def _sides(values: np.ndarray, point: np.uint64, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home on the near side; whether the near and the far side may hold a value within ``reach``."""
    distance = np.bitwise_count(values ^ point).astype(np.int64)
    return distance <= 7, distance - reach <= 7, distance + reach > 7


def homes(values: np.ndarray, points: np.ndarray) -> np.ndarray:
    leaf = np.zeros(len(values), np.int64)
    for point in points:
        leaf = 2 * leaf + ~_sides(values, point, 0)[0]
    return leaf


def visits(values: np.ndarray, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, leaf)`` for every leaf that may hold a neighbour of ``values[row]``."""
    row, leaf = np.arange(len(values)), np.zeros(len(values), np.int64)
    for point in points:
        _, near, far = _sides(values[row], point, reach)
        row, leaf = np.concatenate([row[near], row[far]]), np.concatenate([2 * leaf[near], 2 * leaf[far] + 1])
    return row, leaf


class Forest:
    """Union-find over row numbers, fed with whole arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            pairs = np.unique(np.stack([np.maximum(la, lb)[apart], np.minimum(la, lb)[apart]], axis=1), axis=0)
            first = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
            moved = np.arange(len(self.label))
            moved[pairs[first, 0]] = pairs[first, 1]  # each label to its smallest neighbour, which is smaller
            self.links += [tuple(x) for x in pairs[first].tolist()]
            while not np.array_equal(moved, after := moved[moved]):
                moved = after
            self.label = moved[self.label]


def links_of_shard(prints: np.ndarray, own: np.ndarray, quarter: int, depth: int, rule: SimhashRule) -> list[tuple[int, int]]:
    """Spanning links (row numbers) among the pairs of a home row (``own``) and any other within reach."""
    values = quarter_of(prints, quarter)
    points = vantage_points(quarter, rule.seed, rule.leaf_depth)[depth:]
    reach = rule.max_differing // QUARTERS
    at_home = np.flatnonzero(own)
    leaf = homes(values[at_home], points)
    order = np.argsort(leaf, kind="stable")
    at_home, leaf = at_home[order], leaf[order]
    row, asked = visits(values, points, reach)
    order = np.argsort(asked, kind="stable")
    row, asked = row[order], asked[order]
    forest = Forest(len(prints))
    for number in np.unique(leaf):
        mine = at_home[slice(*np.searchsorted(leaf, [number, number + 1]))]
        theirs = row[slice(*np.searchsorted(asked, [number, number + 1]))]
        step = max(1, rule.block_cells // len(mine))
        for k in range(0, len(theirs), step):
            block = theirs[k:k + step]
            close = np.bitwise_count(prints[block][:, None] ^ prints[mine][None, :]) <= rule.max_differing
            i, j = np.nonzero(close)
            forest.join(block[i], mine[j])
    return forest.links


def quarter_of(prints: np.ndarray, quarter: int) -> np.ndarray:
    return (prints >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)


def close_links(prints: DataFrame, rule: SimhashRule) -> DataFrame:
    """``a, b``: links between distinct ``print`` values that connect all that differ in few bits.

    The depth of the shards follows the number of prints; a home leaf that is still large is cut by a
    hash of its rows, and those who ask in it ask in each cut.
    """
    total = prints.count()
    depth = min(rule.max_depth, max(rule.min_depth, math.ceil(math.log2(max(1, total) / rule.shard_size))))
    reach = rule.max_differing // QUARTERS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("print").to_numpy().view(np.uint64)
            for quarter in range(QUARTERS):
                values, points = quarter_of(own, quarter), vantage_points(quarter, rule.seed, rule.leaf_depth)[:depth]
                home = homes(values, points)
                row, leaf = visits(values, points, reach)
                yield pa.RecordBatch.from_arrays([
                    pa.array((quarter << 16 | leaf).astype(np.int32)), pa.array(home[row] == leaf), pa.array(own[row].view(np.int64)),
                ], ["shard", "own", "print"])

    dealt = prints.select("print").mapInArrow(deal, "shard int, own boolean, print bigint")
    sizes = dealt.where("own").groupBy("shard").count().where(F.col("count") > 2 * rule.shard_size).collect()  # a row per shard
    cuts = {r["shard"]: -(-r["count"] // rule.shard_size) for r in sizes}
    if cuts:
        number = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
        parts = F.coalesce(F.try_element_at(number, F.col("shard")), F.lit(1))
        home_cut = F.pmod(F.xxhash64("print"), parts).cast("int")
        dealt = dealt.withColumn("home_cut", home_cut).withColumn("cut", F.explode(F.sequence(F.lit(0), parts - 1)))
        dealt = dealt.select("shard", "cut", (F.col("own") & (F.col("cut") == F.col("home_cut"))).alias("own"), "print")
    else:
        dealt = dealt.withColumn("cut", F.lit(0))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["print"].to_numpy().view(np.uint64)
        links = links_of_shard(own, rows["own"].to_numpy(bool), int(rows["shard"].iloc[0]) >> 16, depth, rule)
        ends = own.view(np.int64)[np.array(links, np.int64).reshape(-1, 2)]
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    return dealt.groupBy("shard", "cut").applyInPandas(search, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: SimhashRule = SimhashRule()) -> DataFrame:
    """``id, fingerprint, component_id`` for every row: 16 hex digits, and the smallest id reachable by links.

    Null, empty and blank texts have fingerprint 0 and link like any other. Rows without an id take part
    by their fingerprint but are never the smallest; a group of such rows alone has a null component.
    Repeated rows come back as often as they came. A table without rows gives none.
    """
    (name,) = fresh(["fingerprint", "component_id"], id) if id in ("fingerprint", "component_id") else (id,)
    ensure_checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, id, text, rule).checkpoint()
    prints = rows.groupBy("print").agg(F.min("id").alias("least"))
    groups = components(close_links(prints, rule), "a", "b")
    member = prints.join(groups, prints["print"] == groups["node"], "left").select(
        "print", "least", F.coalesce("component", "print").alias("component")
    )
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = member.join(smallest, "component").select("print", "component_id").checkpoint()
    return rows.join(named, "print").select(
        F.col("id").alias(name), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: SimhashRule = SimhashRule()) -> DataFrame:
    """``docs`` without the rows whose group of near copies has a smaller id; own columns only.

    Rows without an id stay. Of rows that share the smallest id all stay.
    """
    (kept,) = fresh(docs.columns, "kept")
    groups = simhash_groups(docs, id, text, rule)
    first = groups.where(F.col(id) == F.col("component_id")).select(F.col(id).alias(kept)).distinct()
    same = docs[id].cast("bigint") == first[kept]
    return docs.join(first, same, "left").where(F.col(kept).isNotNull() | docs[id].isNull()).drop(kept)

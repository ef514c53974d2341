"""Near copies among embeddings, by a pivot-permutation index.

A few reference points (pivots) are taken from the table. Every vector is described by its nearest
pivots; two vectors that point the same way share most of theirs. An inverted list per label and pivot
holds the vectors that have this pivot among their nearest. Two vectors meet in the list of the first
pivot they share, only there; those that share enough pivots are then compared by cosine.

Equal vectors are one row with a count from the start. A list that is long is cut into tiles, each pair
of cuts being a task of its own. A task gives counts of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tugboard.llm.components import components
from tugboard.llm.shared import bounded_batches, fresh
from tugboard.llm.simhash_dedup import Forest
from tugboard.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class PivotRule:
    least_cosine: float = 0.98
    pivots: int = 128         # reference points: of the usable vectors with the smallest hashes of their ids, the first different ones
    nearest: int = 8          # of them that describe a vector
    least_shared: int = 2     # that two vectors must share to be compared (all, where the table has fewer)
    tile_rows: int = 4096     # of a list that one side of a task holds
    block_cells: int = 4_000_000


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have a direction, and these scaled to length 1 in double precision.

    Null, empty, zero, and non-finite vectors and those with null components have none. Vectors are
    scaled by their largest component first, so that no square overflows or vanishes.
    """
    usable = [k for k, v in enumerate(vectors) if v is not None and len(v) and all(x is not None for x in v)]
    if not usable:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    width = max(len(vectors[k]) for k in usable)
    rows = np.zeros((len(usable), width))
    for at, k in enumerate(usable):
        rows[at, :len(vectors[k])] = vectors[k]
    finite = np.isfinite(rows).all(axis=1)
    largest = np.abs(np.where(finite[:, None], rows, 0)).max(axis=1)
    good = finite & (largest > 0)
    rows = rows[good] / largest[good, None]
    return np.array(usable, np.int64)[good], rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _widen(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows[:, :width]


def filled_up(units: list) -> np.ndarray:
    """Rows of any lengths as an array, with zeros after the shorter ones."""
    lengths = np.array([len(u) for u in units], np.int64)
    rows = np.zeros((len(units), int(lengths.max(initial=0))))
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = np.concatenate([*units, np.zeros(0)])
    return rows


def first_different(rows: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` rows that no earlier one equals, in their order."""
    return rows[np.sort(np.unique(rows, axis=0, return_index=True)[1])[:most]]


def permutations(rows: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of the nearest pivots of each row, nearest first; of equally near ones the smaller number first."""
    return np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :nearest]


def tile_links(left: pd.DataFrame, right: pd.DataFrame | None, pivot: int, rule: PivotRule) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links met in one tile of a list: for each row the vectors it links with, and spanning links (row numbers).

    ``right`` is the other cut of the list, or None for the pairs within ``left``.
    """
    both = left if right is None else pd.concat([left, right], ignore_index=True)
    units = filled_up(both["unit"].tolist())
    marks = np.zeros((len(both), (rule.pivots + 63) // 64), np.uint64)
    for place in np.array(both["near"].tolist(), np.int64).T:
        np.bitwise_or.at(marks, (np.arange(len(both)), place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    copies = both["copies"].to_numpy(np.int64)
    linked, forest = np.zeros(len(both), np.int64), Forest(len(both))
    columns = np.arange(len(both)) if right is None else np.arange(len(left), len(both))
    step = max(1, rule.block_cells // max(1, len(columns)))
    for begin in range(0, len(left), step):
        rows = np.arange(begin, min(begin + step, len(left)))
        i, j = np.nonzero(units[rows] @ units[columns].T >= rule.least_cosine - 1e-9)
        i, j = rows[i], columns[j]
        ordered = i < j
        i, j = i[ordered], j[ordered]
        shared = marks[i] & marks[j]
        first = np.full(len(i), -1)
        for word in range(shared.shape[1] - 1, -1, -1):
            bits = shared[:, word]
            lowest = np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            first = np.where(bits > 0, 64 * word + lowest, first)
        here = (first == pivot) & (np.bitwise_count(shared).sum(axis=1) >= rule.least_shared)
        i, j = i[here], j[here]
        cosine = np.einsum("ij,ij->i", units[i], units[j])
        i, j = i[cosine >= rule.least_cosine], j[cosine >= rule.least_cosine]
        linked += np.bincount(i, copies[j], len(both)).astype(np.int64) + np.bincount(j, copies[i], len(both)).astype(np.int64)
        forest.join(i, j)
    return linked, forest.links


def near_copies(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                rule: PivotRule = PivotRule()) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row: links to rows of the same label at ``least_cosine`` or more.

    Rows whose label is null or whose vector is null, empty, zero or holds null or non-finite components
    link with nothing. Shorter vectors count as filled up with zeros. Rows that share an id are one
    vector each. Rows without an id link, but are never the smallest: next to a row with an id they go;
    among themselves or alone they have no component and are kept. A table without rows gives none.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    bounded_batches(spark)
    (name,) = fresh(["n_links", "component_id", "kept"], id)
    taken = vectors.select(
        F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("string").alias("label")
    )
    usable = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)  # NaN is above all
    sample = taken.where(usable & F.col("label").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(4 * rule.pivots)
    found = unit_rows([r.vector for r in sample.select("vector").collect()])[1]
    pivots = first_different(found, rule.pivots) if len(found) else np.zeros((1, 1))
    rule = replace(rule, least_shared=min(rule.least_shared, len(pivots)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, units = unit_rows(batch.column(1).to_pylist())
            width = max(pivots.shape[1], units.shape[1] if len(good) else 0)
            near = permutations(_widen(units, width), _widen(pivots, width), rule.nearest) if len(good) else np.zeros((0, 0), int)
            units_of, near_of = [None] * len(batch), [None] * len(batch)
            ends = units.shape[1] - np.argmax(units[:, ::-1] != 0, axis=1) if len(good) else good
            for k, unit, end, places in zip(good.tolist(), units.tolist(), ends.tolist(), near.tolist(), strict=True):
                units_of[k], near_of[k] = unit[:end], places  # without zeros at the end: a vector and its longer copies are equal
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(units_of, pa.list_(pa.float64())), pa.array(near_of, pa.list_(pa.int32())),
            ], ["id", "label", "unit", "near"])

    described = taken.mapInArrow(describe, "id bigint, label string, unit array<double>, near array<int>").withColumn(
        "copy", F.when(F.col("label").isNotNull() & F.col("unit").isNotNull(), F.xxhash64("label", "unit"))
    ).checkpoint()
    able = described.where("copy is not null")
    # Equal vectors of a label are one class, named by a hash of both.
    classes = able.groupBy("copy", "label").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first("unit").alias("unit"), F.first("near").alias("near")
    ).checkpoint()
    listed = classes.select("label", F.explode("near").alias("pivot"), "copy", "copies", "unit", "near")
    cuts = listed.groupBy("label", "pivot").agg(F.ceil(F.count(F.lit(1)) / rule.tile_rows).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("copy", "pivot"), F.col("cuts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    tiles = listed.join(cuts, ["label", "pivot"]).withColumn("cut", cut).withColumn("other", other).select(
        "label", "pivot", F.least("cut", "other").alias("a"), F.greatest("cut", "other").alias("b"), "cut", "copy", "copies", "unit", "near"
    )

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
        left = rows[rows["cut"] == a].reset_index(drop=True)
        right = None if a == b else rows[rows["cut"] == b].reset_index(drop=True)
        linked, links = tile_links(left, right, int(rows["pivot"].iloc[0]), rule)
        names = np.concatenate([left["copy"], right["copy"]]) if right is not None else left["copy"].to_numpy()
        own = np.flatnonzero(linked)
        ends = names[np.array(links, np.int64).reshape(-1, 2)]
        return pd.DataFrame({
            "a": np.concatenate([names[own], ends[:, 0]]), "b": np.concatenate([names[own], ends[:, 1]]),
            "n": np.concatenate([linked[own], np.zeros(len(ends), np.int64)]),
        })

    met = tiles.groupBy("label", "pivot", "a", "b").applyInPandas(search, "a bigint, b bigint, n bigint").checkpoint()
    links = met.groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(met, "a", "b")
    member = classes.join(links, classes["copy"] == links["a"], "left").join(groups, classes["copy"] == groups["node"], "left").select(
        "copy", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "copy").alias("component")
    ).checkpoint()
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = member.join(smallest, "component").select("copy", "n_links", "component_id").checkpoint()
    return described.join(named, "copy", "left").select(
        F.col("id").alias(name), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.col("component_id").isNull()).alias("kept"),
    )

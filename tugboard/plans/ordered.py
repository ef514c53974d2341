"""Neighbours and running totals in ordered groups, also where one group holds most rows.

A plain window sends a whole group to one task. Here the sizes of the groups are counted first (a
hash aggregate with map-side combine). Groups up to ``hot_rows`` go through plain windows. The rows
of larger ones are range-partitioned on (keys, order), which cuts a group into contiguous slices of
about ``slice_rows`` rows wherever its rows lie, ties included. Windows then run per slice, and what
a slice needs from those before it comes from a table with one row per (group, slice).

The slices are written to a checkpoint before use. The range bounds come from a sample, so both
readers of the slices must see the same cut, also when a lost executor makes Spark redo a stage.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tugboard.config import DEFAULTS, PanelSettings
from tugboard.plans.memo import remembered
from tugboard.plans.sizes import session_sizes
from tugboard.session import ensure_checkpoint_dir

SLICE = "_slice"
SLICES_A_CORE = 8

_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda source: F.last(source, ignorenulls=True)}


def _combine(kind: str, mine: Column, before: Column) -> Column:
    if kind == "sum":
        return mine + F.coalesce(before, F.lit(0))
    if kind == "last":
        return F.coalesce(mine, before)
    return F.greatest(mine, before) if kind == "max" else F.least(mine, before)


def hot_groups(
    rows: DataFrame, keys: Sequence[str], limit: int, weight: str | None = None
) -> DataFrame | None:
    """All groups with more than ``limit`` rows, written down, or None.

    With ``weight`` the rows are counts already, and that column is summed.
    """
    def find() -> DataFrame | None:
        size = F.count(F.lit(1)) if weight is None else F.sum(weight)
        ensure_checkpoint_dir(rows.sparkSession)
        found = rows.groupBy(*keys).agg(size.alias("_rows")).where(F.col("_rows") > limit).checkpoint()
        return found if _number(found) else None

    return remembered(rows, ("hot_groups", *keys, limit, weight), find)


def _number(listed: DataFrame) -> int:
    return remembered(listed, "number", listed.count)


def _small(listed: DataFrame, n: int, settings: PanelSettings) -> DataFrame:
    """``listed``, a table of ``n`` rows, broadcast if it may be; else Spark shuffles and splits skewed keys."""
    return F.broadcast(listed) if n <= settings.broadcast_rows else listed


def hot_by_counts(counts: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """The same for keys that begin with the session, from the small table of change counts."""
    if session_sizes(counts).largest <= limit:
        return None
    return hot_groups(counts, keys, limit, "changes")


def combine_large(
    rows: DataFrame, counts: DataFrame, settings: PanelSettings, combine: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``combine`` applied to the rows of large sessions only; it must keep the columns.

    Combining costs a shuffle of its own. It pays where a session is large, and would only be in the
    way of all others.
    """
    large = hot_by_counts(counts, ["session_id"], settings.hot_rows)
    if large is None:
        return rows
    marked = _small(large.select("session_id"), _number(large), settings)
    small = rows.join(marked, "session_id", "left_anti")
    return small.unionByName(combine(rows.join(marked, "session_id", "left_semi")))


@dataclass(frozen=True)
class OrderedGroups:
    frame: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    sliced: bool
    small_carry: bool = True  # whether a table with a row per slice and hot group may be broadcast

    @property
    def partition(self) -> list[str]:
        return [*self.keys, SLICE] if self.sliced else list(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def _slices(self) -> DataFrame:
        return self.frame.where(F.col(SLICE) >= 0)

    def _carry(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.small_carry else table

    def _neighbour(self, columns: dict[str, str], forward: bool) -> OrderedGroups:
        packed = F.struct(*[F.col(source).alias(name) for name, source in columns.items()])
        shift = F.lead if forward else F.lag
        near = self.frame.withColumn("_near", shift(packed).over(self.window()))
        if self.sliced:
            pick = F.min_by if forward else F.max_by
            edge = self._slices().groupBy(*self.partition).agg(
                pick(packed, F.struct(*self.order)).alias("_edge")
            )
            along = Window.partitionBy(*self.keys).orderBy(SLICE)
            beyond = edge.select(*self.partition, shift("_edge").over(along).alias("_beyond"))
            near = near.join(self._carry(beyond), self.partition, "left").withColumn(
                "_near", F.coalesce("_near", "_beyond")
            ).drop("_beyond")
        opened = near.select(*self.frame.columns, *[F.col(f"_near.{name}").alias(name) for name in columns])
        return replace(self, frame=opened)

    def previous(self, **columns: str) -> OrderedGroups:
        """Adds ``name=source``: the value of ``source`` in the row before, NULL in the first row."""
        return self._neighbour(columns, forward=False)

    def following(self, **columns: str) -> OrderedGroups:
        return self._neighbour(columns, forward=True)

    def _of_slice(self, kind: str, source: str) -> Column:
        if kind == "last":  # rows of an aggregation have no order of their own
            return F.max_by(source, F.when(F.col(source).isNotNull(), F.struct(*self.order)))
        return _AGGREGATES[kind](source)

    def running(self, **totals: tuple[str, str]) -> OrderedGroups:
        """Adds ``name=(kind, source)``: the sum, max, min or last value of ``source`` up to and with this row.

        "last" is the last one that is not NULL. A total may take the name of its own source and then replaces it.
        """
        kept = [name for name in self.frame.columns if name not in totals]
        upto = self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added = self.frame.select(
            *kept,
            *[_AGGREGATES[kind](source).over(upto).alias(name) for name, (kind, source) in totals.items()],
        )
        if self.sliced:
            before = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
            per_slice = self._slices().groupBy(*self.partition).agg(
                *[self._of_slice(kind, source).alias(name) for name, (kind, source) in totals.items()]
            )
            carried = per_slice.select(
                *self.partition,
                *[_AGGREGATES[kind](name).over(before).alias(f"_c_{name}") for name, (kind, _) in totals.items()],
            )
            joined = added.join(self._carry(carried), self.partition, "left")
            added = joined.select(
                *kept,
                *[
                    _combine(kind, F.col(name), F.col(f"_c_{name}")).alias(name)
                    for name, (kind, _) in totals.items()
                ],
            )
        return replace(self, frame=added)

    def whole(self, **totals: tuple[str, str]) -> OrderedGroups:
        """Adds ``name=(kind, source)`` over the whole group."""
        everything = Window.partitionBy(*self.partition)
        names = list(totals)
        added = self.frame.select(
            *self.frame.columns,
            *[_AGGREGATES[kind](source).over(everything).alias(name) for name, (kind, source) in totals.items()],
        )
        if self.sliced:
            hot = self._slices().groupBy(*self.keys).agg(
                *[_AGGREGATES[kind](source).alias(f"_w_{name}") for name, (kind, source) in totals.items()]
            )
            joined = added.join(self._carry(hot), list(self.keys), "left")
            added = joined.select(
                *self.frame.columns,
                *[F.coalesce(F.col(f"_w_{name}"), F.col(name)).alias(name) for name in names],
            )
        return replace(self, frame=added)

    def derive(self, **columns: Column) -> OrderedGroups:
        """Adds columns computed row by row."""
        return replace(self, frame=self.frame.withColumns(columns))

    def keep(self, condition: Column) -> OrderedGroups:
        """Only the rows that meet ``condition``, in the same slices."""
        return replace(self, frame=self.frame.where(condition))

    def small(self) -> DataFrame:
        """The rows of groups that are not sliced."""
        return self.frame.where(F.col(SLICE) < 0).drop(SLICE) if self.sliced else self.frame

    def large(self) -> DataFrame:
        """The rows of sliced groups."""
        return self.frame.where(F.col(SLICE) >= 0).drop(SLICE)

    def done(self) -> DataFrame:
        return self.frame.drop(SLICE)


def slices_of(total: int, settings: PanelSettings, cores: int) -> int:
    """Slices of about ``slice_rows`` rows; if they are small and more than the cores have use for, fewer and larger ones.

    Each slice is a task and a file of every later step, and a hundred sampled rows at the driver.
    """
    useful = max(SLICES_A_CORE * cores, math.ceil(total / max(settings.slice_rows, DEFAULTS.slice_rows)))
    return max(2, min(math.ceil(total / settings.slice_rows), useful))


def cores_of(rows: DataFrame) -> int:
    return rows.sparkSession.sparkContext.defaultParallelism


def slice_rows(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], total: int, settings: PanelSettings
) -> DataFrame:
    """``rows`` range-partitioned on (keys, order) and written down, with the number of their slice.

    ``total`` is roughly how many there are. Only groups that are large should come here.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.repartitionByRange(slices_of(total, settings, cores_of(rows)), *keys, *order).withColumn(SLICE, F.spark_partition_id()).checkpoint()


def order_groups(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    settings: PanelSettings,
    counts: DataFrame | None = None,
) -> OrderedGroups:
    """Lay ``rows`` out by ``keys``, ordered by ``order`` (which must be total within a group).

    ``counts`` may be a small table whose ``changes`` add up, per group, to at least the rows of that
    group; the rows need not be counted then.
    """
    keys, order = tuple(keys), tuple(order)
    if counts is None:
        hot = hot_groups(rows, keys, settings.hot_rows)
    else:
        hot = hot_by_counts(counts, keys, settings.hot_rows)
    if hot is None:
        return OrderedGroups(rows, keys, order, sliced=False)

    # Where rows are an aggregate by the same keys, the optimizer moves
    # both joins below it, so each row is aggregated on one side only.
    marked = _small(hot.select(*keys), _number(hot), settings)
    total = hot.agg(F.sum("_rows")).first()[0]
    cut = slice_rows(rows.join(marked, list(keys), "left_semi"), keys, order, total, settings)
    rest = rows.join(marked, list(keys), "left_anti").withColumn(SLICE, F.lit(-1))
    # A slice can end one hot group and begin another, so there are at most this many parts of groups.
    parts = slices_of(total, settings, cores_of(rows)) + _number(hot)
    return OrderedGroups(rest.unionByName(cut), keys, order, sliced=True, small_carry=parts <= settings.broadcast_rows)

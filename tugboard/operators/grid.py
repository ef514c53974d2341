"""Step functions on the tick grid, held as runs of ticks and spelled out only on request.

Of all changes between two ticks only the last can be seen on the grid. Sessions of ordinary size are
put in order with one shuffle, and the last change of each tick is kept there. Where a session is
large, its changes are first combined to one per (series, tick), which starts before the shuffle, so
what is put in order is at most one row per tick, however many changes there were. Series that are still large
are ordered in slices (``plans/ordered.py``): the next change, the last value of each user and the owner before
are carried from slice to slice, and a stretch of ownership goes on over as many slices as it lasts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tugboard.config import DEFAULTS, LINE, PanelSettings
from tugboard.functions.clock import first_tick_beyond, first_tick_from, tick_time
from tugboard.operators.roster import change_counts, session_bounds, users_by_params
from tugboard.plans.joins import attach_facts
from tugboard.plans.ordered import OrderedGroups, combine_large, order_groups
from tugboard.plans.sizes import session_sizes

TICK_BLOCK = 65_536
GRID = ("t_min", "step", "n_ticks")


_PLACED = ("lo", "time_sec", "user", *LINE, "value")


def _on_grid(chosen: DataFrame, events: DataFrame, keys: Sequence[str], settings: PanelSettings) -> DataFrame:
    """The ``chosen`` events with the first tick that sees them, on the grid all ``events`` span."""
    on_grid = attach_facts(
        chosen,
        session_bounds(events, settings).select("session_id", *GRID),
        ["session_id"],
        ["param", "user", "mid", "time_sec"],
        session_sizes(change_counts(events, keep=True)).sessions,
        settings,
    ).withColumn("lo", first_tick_from(F.col("time_sec"), F.col("t_min"), F.col("step")))
    extra = [c for c in _PLACED if c not in keys]
    return on_grid.where(F.col("lo") < F.col("n_ticks")).select(*keys, *GRID, *extra)


def _placed(chosen: DataFrame, events: DataFrame, keys: Sequence[str], settings: PanelSettings) -> DataFrame:
    """The ``chosen`` events on the grid; of large sessions only the last change per (series, tick)."""
    placed = _on_grid(chosen, events, keys, settings)
    return combine_large(placed, change_counts(events, keep=True), settings, lambda rows: _last_per_tick(rows, keys))


def _marker(series: DataFrame, keys: Sequence[str], lo: Column) -> DataFrame:
    """One row without a value per series, at tick ``lo``, shaped like ``_placed``."""
    kinds = {"time_sec": "double", "user": "int", "file": "string", "block_start": "long", "mid": "long", "value": "double"}
    empty = [F.lit(None).cast(kind).alias(c) for c, kind in kinds.items() if c not in keys]
    return series.select(*keys, *GRID, lo.cast("long").alias("lo"), *empty)


def _in_tick_order(placed: DataFrame, keys: Sequence[str], events: DataFrame, settings: PanelSettings) -> OrderedGroups:
    order = ["lo", "time_sec", *(["user"] if "user" not in keys else []), *LINE]
    return order_groups(placed, keys, order, settings, change_counts(events, keep=True))


def _last_per_tick(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in _PLACED if c not in keys and c != "lo"]
    last = F.max_by(F.struct(*rest), F.struct("time_sec", "user", *LINE)).alias("last")
    return placed.groupBy(*keys, *GRID, "lo").agg(last).select(*keys, *GRID, "lo", "last.*")


def _runs(ordered: OrderedGroups, keys: Sequence[str], blank: bool) -> OrderedGroups:
    """Runs ``[lo, hi)`` of ticks under one change; ``blank`` adds the ticks before the first one."""
    rows = ordered.following(hi="lo").derive(hi=F.coalesce("hi", "n_ticks"))
    if not blank:
        return rows.derive(owner=F.col("user")).keep(F.col("hi") > F.col("lo"))
    rows = rows.previous(before="lo")
    kind = dict(rows.frame.dtypes)["user"]
    held = F.struct("lo", "hi", "value", F.col("user").alias("owner"))
    first = F.struct(
        F.lit(0).cast("long").alias("lo"), F.col("lo").alias("hi"), F.lit(None).cast("double").alias("value"),
        F.lit(None).cast(kind).alias("owner"),
    )
    both = F.inline(F.when(F.col("before").isNull(), F.array(first, held)).otherwise(F.array(held)))
    frame = rows.frame.select(*ordered.partition, *GRID, both)
    return replace(rows, frame=frame, order=("lo",)).keep(F.col("hi") > F.col("lo"))


def _only(rows: DataFrame, users: Sequence[int] | None, params: Sequence[str] | None) -> DataFrame:
    if params is not None:
        rows = rows.where(F.col("param").isin(*params) if params else F.lit(False))
    if users is not None:
        rows = rows.where(F.col("user").isin(*users) if users else F.lit(False))
    return rows


def merged_runs(
    events: DataFrame,
    settings: PanelSettings = DEFAULTS,
    params: Sequence[str] | None = None,
    blank: bool = False,
) -> DataFrame:
    """Per parameter: runs ``[lo, hi)`` of ticks under the value and the user of the last change.

    ``blank`` adds the ticks before the first change, without value or owner.
    """
    runs = _merged(events, settings, params, blank).done()
    return runs.select("session_id", "param", *GRID, "lo", "hi", "value", "owner")


def _merged(events: DataFrame, settings: PanelSettings, params: Sequence[str] | None, blank: bool) -> OrderedGroups:
    keys = ("session_id", "param")
    placed = _placed(_only(events, None, params), events, keys, settings)
    if blank:
        listed = _only(change_counts(events), None, params).select(*keys).distinct()
        series = listed.join(session_bounds(events, settings), "session_id")
        placed = placed.unionByName(_marker(series, keys, F.col("n_ticks")))
    return _runs(_in_tick_order(placed, keys, events, settings), keys, blank)


def user_runs(
    events: DataFrame,
    settings: PanelSettings = DEFAULTS,
    users: Sequence[int] | None = None,
    params: Sequence[str] | None = None,
) -> DataFrame:
    """The same per user: the value each user set last, for every user and parameter of the session."""
    keys = ("session_id", "param", "user")
    placed = _placed(_only(events, users, params), events, keys, settings)
    listed = _only(users_by_params(change_counts(events)), users, params)
    series = listed.join(session_bounds(events, settings), "session_id")
    placed = placed.unionByName(_marker(series, keys, F.col("n_ticks")))
    runs = _runs(_in_tick_order(placed, keys, events, settings), keys, blank=True).done()
    return runs.select(*keys, *GRID, "lo", "hi", "value")


def stretch_runs(
    events: DataFrame,
    start: float | None,
    width: float,
    settings: PanelSettings = DEFAULTS,
    users: Sequence[int] | None = None,
    params: Sequence[str] | None = None,
    before: DataFrame | None = None,
) -> DataFrame:
    """``user_runs`` cut to the ticks in the closed range ``[start, start + width]``; None starts at the session's begin.

    Only the changes in the range are put in order. What came earlier is one row per series, its last change,
    combined before the shuffle. ``before`` may hold last changes of a time from which ``events`` are complete; then
    nothing earlier need be in ``events``, whose change counts must be those of all.
    """
    keys = ("session_id", "param", "user")
    begin = F.col("t_min") if start is None else F.lit(start)
    placed = _on_grid(_only(events, users, params), events, keys, settings)
    inside = placed.where((F.col("time_sec") >= begin) & (F.col("time_sec") <= begin + F.lit(width)))
    counts = change_counts(events, keep=True)
    rows = combine_large(inside, counts, settings, lambda large: _last_per_tick(large, keys))
    if start is not None:
        history = placed.where(F.col("time_sec") < begin)
        if before is not None:
            history = history.unionByName(_on_grid(_only(before, users, params), events, keys, settings))
        rest = [c for c in _PLACED if c not in keys]
        last = F.max_by(F.struct(*rest), F.struct("time_sec", *LINE)).alias("last")
        rows = rows.unionByName(history.groupBy(*keys, *GRID).agg(last).select(*keys, *GRID, "last.*"))
    listed = _only(users_by_params(counts), users, params)
    series = listed.join(session_bounds(events, settings), "session_id")
    rows = rows.unionByName(_marker(series, keys, F.col("n_ticks")))
    runs = _runs(_in_tick_order(rows, keys, events, settings), keys, blank=True).done()
    return clip_runs(runs.select(*keys, *GRID, "lo", "hi", "value"), None if start is None else F.lit(start), width)


def clip_runs(runs: DataFrame, start: Column | None, width: float) -> DataFrame:
    """Runs cut to the ticks in the closed range ``[start, start + width]``; None starts at the session's."""
    begin = F.col("t_min") if start is None else start
    end = begin + F.lit(width)
    return runs.withColumns({
        "lo": F.greatest("lo", first_tick_from(begin, F.col("t_min"), F.col("step"))),
        "hi": F.least("hi", first_tick_beyond(end, F.col("t_min"), F.col("step"))),
    }).where(F.col("hi") > F.col("lo"))


def spell_out(runs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per tick. Nothing is shuffled after this, so the long form is never moved.

    Runs are cut into blocks first: no array is longer than TICK_BLOCK or the number of a run's blocks.
    """
    blocks = F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(TICK_BLOCK).cast("long")))
    until = F.least(F.col("block") + TICK_BLOCK, F.col("hi"))
    ticks = F.explode(F.sequence(F.col("block"), until - 1))
    return runs.where(F.col("hi") > F.col("lo")).withColumn("block", blocks).withColumn("i", ticks).select(
        "session_id",
        "param",
        "i",
        tick_time(F.col("i"), F.col("t_min"), F.col("step")).alias("t"),
        *columns,
    )


def merged_series(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """Value and owner of each parameter at each tick; both NULL before the first change."""
    return spell_out(merged_runs(events, settings, blank=True), ["value", "owner"])


def locf_series(events: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """Each user's last own value of each parameter at each tick; NULL before the first change."""
    return spell_out(user_runs(events, settings), ["user", "value"])


def ownership_segments(
    events: DataFrame, settings: PanelSettings = DEFAULTS, users: Sequence[int] | None = None
) -> DataFrame:
    """Maximal stretches of ticks under one owner, for the shared parameters."""
    runs = _merged(events, settings, settings.shared_params, blank=False).previous(before="owner")
    fresh = F.col("before").isNull() | (F.col("before") != F.col("owner"))
    numbered = runs.derive(stretch=fresh.cast("long")).running(stretch=("sum", "stretch")).done()
    stretches = numbered.groupBy("session_id", "param", "stretch", *GRID).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("owner").alias("owner")
    )
    if users is not None:
        stretches = stretches.where(F.col("owner").isin(*users) if users else F.lit(False))
    return stretches.select(
        "session_id",
        "param",
        "owner",
        tick_time(F.col("lo"), F.col("t_min"), F.col("step")).alias("start_time"),
        tick_time(F.col("hi") - 1, F.col("t_min"), F.col("step")).alias("end_time"),
        (F.col("hi") - F.col("lo")).alias("ticks"),
    )


def series_wide(events: DataFrame, users: Sequence[int], settings: PanelSettings = DEFAULTS) -> DataFrame:
    """Tick by user matrix of each parameter, one column ``user_<n>`` per listed user.

    Each change becomes a row with its value in its user's column. The columns are filled forward
    along the series, and the ticks are spelled out last, so the long form is never shuffled.
    """
    keys = ("session_id", "param")
    placed = _placed(events, events, (*keys, "user"), settings).where(F.col("user").isin(*users))
    listed = change_counts(events).select(*keys).distinct()
    series = listed.join(session_bounds(events, settings), "session_id")
    rows = placed.unionByName(_marker(series, keys, F.lit(-1))).withColumns({
        f"user_{u}": F.when(F.col("user") == u, F.col("value")) for u in users
    })
    filled = (
        _in_tick_order(rows, keys, events, settings).following(hi="lo").running(**{f"user_{u}": ("last", f"user_{u}") for u in users})
        .derive(lo=F.greatest("lo", F.lit(0)), hi=F.coalesce("hi", "n_ticks")).done()
    )
    return spell_out(filled.where(F.col("hi") > F.col("lo")), [f"user_{u}" for u in users])

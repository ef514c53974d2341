"""Selections: some users and parameters, a stretch of time, a page of parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tugboard.config import DEFAULTS, PanelSettings
from tugboard.operators.grid import spell_out, stretch_runs, user_runs
from tugboard.sources.session_store import SessionStore


def select_view(
    events: DataFrame, users: Sequence[int], params: Sequence[str], settings: PanelSettings = DEFAULTS
) -> DataFrame:
    """The per-user series of the chosen users and parameters; an empty choice gives no rows.

    The choice is applied to the events, so nothing is computed for what is not shown.
    """
    return spell_out(user_runs(events, settings, users, params), ["user", "value"])


def time_viewport(
    events: DataFrame,
    start: float | None = None,
    full: bool = False,
    settings: PanelSettings = DEFAULTS,
    users: Sequence[int] | None = None,
    params: Sequence[str] | None = None,
) -> DataFrame:
    """The per-user series in the closed stretch ``[start, start + viewport]``, or in full.

    Without a start the stretch begins with the session. Changes after the stretch are left out, and of those
    before it each series keeps one, before anything is put in order.
    """
    if full:
        runs = user_runs(events, settings, users, params)
    else:
        runs = stretch_runs(events, start, settings.viewport, settings, users, params)
    return spell_out(runs, ["user", "value"])


def stored_viewport(
    store: SessionStore,
    start: float,
    settings: PanelSettings = DEFAULTS,
    users: Sequence[int] | None = None,
    params: Sequence[str] | None = None,
) -> DataFrame:
    """``time_viewport`` from a store: the state before the block of ``start`` and the blocks of the stretch are read."""
    near = store.between(start, start + settings.viewport)
    runs = stretch_runs(near, start, settings.viewport, settings, users, params, before=store.states_at(start))
    return spell_out(runs, ["user", "value"])


def param_page(events: DataFrame, offset: int = 0, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """One page of each session's parameters in name order; the offset stops at the last full page."""
    listed = events.select("session_id", "param").distinct()
    by_name = Window.partitionBy("session_id").orderBy("param")
    numbered = listed.withColumns({
        "place": F.row_number().over(by_name),
        "n": F.count(F.lit(1)).over(Window.partitionBy("session_id")),
    })
    first = F.least(F.lit(offset), F.greatest(F.lit(0), F.col("n") - settings.page_size))
    return numbered.where(
        (F.col("place") > first) & (F.col("place") <= first + settings.page_size)
    ).select("session_id", F.col("place").cast("long").alias("place"), "param")

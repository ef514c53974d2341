"""The grid under layouts that cut every series into slices, against the plain windows."""

from __future__ import annotations

from dataclasses import replace

import pytest
from conftest import make_events, random_rows
from pyspark.sql import functions as F

from tugboard.config import PanelSettings
from tugboard.operators import grid
from tugboard.plans.ordered import SLICE

PLAIN = PanelSettings(tick=0.1, shared_params=("frequency", "offset"))
LAYOUTS = [
    replace(PLAIN, hot_rows=10, slice_rows=30, broadcast_rows=10**6),
    replace(PLAIN, hot_rows=10, slice_rows=7, broadcast_rows=1, fan_out=3),
    replace(PLAIN, hot_rows=150, slice_rows=40),   # some series are cut, some are not
]
OPERATORS = {
    "locf_series": lambda e, s: grid.locf_series(e, s),
    "merged_series": lambda e, s: grid.merged_series(e, s),
    "series_wide": lambda e, s: grid.series_wide(e, range(4), s),
    "ownership_segments": lambda e, s: grid.ownership_segments(e, s),
}


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.fixture(scope="module")
def events(spark):
    rows = random_rows(3, 400) + random_rows(4, 60, users=2, params=("frequency",), span=9.0, tenth=False)
    # One owner for a long time, over several slices; and another parameter with one change.
    rows += [(20 + k / 50, 1, k, "frequency") for k in range(200)] + [(5.0, 2, 1.0, "gain")]
    return make_events(spark, rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_slices_change_nothing(spark, events, name):
    expected = rows_of(OPERATORS[name](events, PLAIN))
    assert len(expected) > 50
    for layout in LAYOUTS:
        assert rows_of(OPERATORS[name](events, layout)) == expected


def test_a_stretch_lasts_over_three_slices(spark):
    """One owner throughout, in many slices: one segment; then the owner changes at every tick."""
    rows = [(k / 10, 1, k, "frequency") for k in range(200)] + [(20 + k / 10, k % 2, k, "frequency") for k in range(100)]
    events = make_events(spark, rows)
    layout = replace(PLAIN, hot_rows=10, slice_rows=20)
    runs = grid._merged(events, layout, ("frequency",), blank=False)
    held = runs.frame.where(F.col("owner") == 1).agg(F.countDistinct(SLICE)).first()[0]
    assert runs.sliced and held >= 3
    found = rows_of(grid.ownership_segments(events, layout))
    assert found == rows_of(grid.ownership_segments(events, PLAIN))
    assert max(r[-1] for r in found) == 200


def test_no_slice_is_much_larger_than_asked_for(spark, events):
    layout = replace(PLAIN, hot_rows=10, slice_rows=40)
    for runs in (grid._merged(events, layout, None, blank=True), grid._merged(events, layout, None, blank=False)):
        largest = runs.frame.where(F.col(SLICE) >= 0).groupBy("session_id", "param", SLICE).count().agg(F.max("count")).first()[0]
        assert largest <= 2 * layout.slice_rows


def test_the_last_value_is_carried_over_empty_slices(spark):
    """A user who sets a value once, and others for a long time after."""
    events = make_events(spark, [(0.0, 3, 7.5)] + [(k / 10, k % 2, k) for k in range(1, 300)])
    layout = replace(PLAIN, hot_rows=10, slice_rows=25)
    wide = grid.series_wide(events, range(4), layout)
    assert {r.user_3 for r in wide.collect()} == {7.5} and {r.user_2 for r in wide.collect()} == {None}
    assert rows_of(wide) == rows_of(grid.series_wide(events, range(4), PLAIN))

"""Stretches of time against the whole series cut to size, from events and from a store."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from conftest import make_events, random_rows
from pyspark.sql import functions as F

from tugboard.config import PanelSettings
from tugboard.operators import activity, grid, views
from tugboard.sources.session_store import read_session_store, write_session_store

PLAIN = PanelSettings(tick=0.1, viewport=7.0, shared_params=("frequency",))
HOT = replace(PLAIN, hot_rows=10, slice_rows=20, broadcast_rows=3, fan_out=3)
STARTS = [0.0, 3.3, 20.0, 41.25, 58.0, 59.95, 80.0]


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.fixture(scope="module")
def events(spark):
    first = make_events(spark, random_rows(1, 300), "one")
    # Series that fall silent early, and a session that ends long before the other.
    second = make_events(spark, [(0.5, 0, 1.0), (0.7, 1, 2.0, "gain"), (9.0, 2, 3.0), (9.0, 2, 4.0)], "two")
    return first.unionByName(second)


@pytest.fixture(scope="module")
def store(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "s")
    write_session_store(events, path, block_seconds=5.0, buckets=3)
    return read_session_store(spark, path)


def expected(events, start):
    begin = None if start is None else F.lit(start)
    runs = grid.clip_runs(grid.user_runs(events, PLAIN), begin, PLAIN.viewport)
    return rows_of(grid.spell_out(runs, ["user", "value"]))


@pytest.mark.parametrize("layout", [PLAIN, HOT])
def test_stretches(events, layout):
    for start in [None, *(STARTS if layout is PLAIN else STARTS[2:4])]:
        assert rows_of(views.time_viewport(events, start, settings=layout)) == expected(events, start)


def test_stored_stretches(events, store):
    for start in STARTS:
        assert rows_of(views.stored_viewport(store, start, PLAIN)) == expected(events, start)
    chosen = views.stored_viewport(store, 20.0, HOT, users=(1, 2), params=("frequency",))
    assert rows_of(chosen) == rows_of(views.time_viewport(events, 20.0, settings=PLAIN, users=(1, 2), params=("frequency",)))


def test_a_stretch_reads_its_blocks_only(store):
    def blocks(frame):
        return {int(re.search(r"block=(\d+)", file)[1]) for file in frame.inputFiles()}

    assert blocks(store.between(21.0, 28.0)) == {4, 5}
    assert blocks(store.states_at(21.0)) == {4}
    assert len(blocks(store.events)) > 8
    # A state is one row per series and block, whatever came before.
    assert store.states.groupBy("block", "session_id", "user", "param").count().where("count > 1").isEmpty()


def test_windows_of_a_store_need_no_shuffle(store):
    plan = grid.merged_runs(store.events, PLAIN)._jdf.queryExecution().executedPlan().toString()
    above_scan = plan[plan.index("Window"):plan.index("FileScan")]
    assert "Exchange" not in above_scan and "Bucketed: true" in plan


def test_operators_read_a_store_like_events(events, store):
    assert rows_of(store.events.drop("block")) == rows_of(events)
    assert rows_of(activity.time_in_control(store.events, PLAIN)) == rows_of(activity.time_in_control(events, PLAIN))


def test_an_empty_store(spark, events, tmp_path):
    write_session_store(events.limit(0), str(tmp_path / "none"), 5.0)
    store = read_session_store(spark, str(tmp_path / "none"))
    assert store.events.count() == 0 and views.stored_viewport(store, 1.0, PLAIN).count() == 0

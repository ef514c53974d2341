from __future__ import annotations

import pytest
from conftest import canonical, make_events, random_rows

import brute
from tugboard.config import PanelSettings
from tugboard.operators.grid import merged_series
from tugboard.operators.conflicts import (
    conflict_annotations,
    conflict_candidates,
    conflict_report,
    detect_conflicts,
    zone_value_stats,
)

LAYOUTS = {
    "plain": {},
    "sliced": dict(hot_rows=40, slice_rows=7),
    "chained": dict(fold_rows=2, chain_rows=3),
    "few parts": dict(fold_rows=2, chain_rows=40),
    "sliced and chained": dict(hot_rows=20, slice_rows=5, fold_rows=1, chain_rows=2),
}


def zones_of(events, settings):
    rows = detect_conflicts(events, settings).orderBy("session_id", "param", "zone_no").collect()
    return [(r.param, r.zone_no, r.start_time, r.end_time, r.users, r.num_changes, r.user_switches) for r in rows]


def simple(times, users):
    return [(t, u, k, "frequency") for k, (t, u) in enumerate(zip(times, users))]


@pytest.mark.parametrize(
    "times,users,expected",
    [
        ([0, 1, 2, 3], [0, 1, 0, 1], [(0.0, 3.0, [0, 1], 4, 3)]),
        ([0, 1, 2, 5.0], [0, 1, 0, 1], [(0.0, 5.0, [0, 1], 4, 3)]),
        ([0, 1, 2, 5.1], [0, 1, 0, 1], []),
        ([0, 1, 2, 3], [0, 0, 1, 1], []),
        ([0, 1, 2], [0, 1, 0], []),
        ([0, 1, 2, 4.5, 6, 7, 8, 9], [0, 1, 0, 1, 0, 1, 0, 1], [(0.0, 9.0, [0, 1], 8, 6)]),
        ([0, 1, 2, 4.5, 7, 7.5, 8, 9], [0, 1, 0, 1, 0, 1, 0, 1], [(0.0, 4.5, [0, 1], 4, 3), (7.0, 9.0, [0, 1], 4, 3)]),
        ([0, 0, 0, 0], [0, 1, 0, 1], []),  # one instant is in user order: a single turn
        ([0, 0, 0, 0], [0, 1, 2, 1], [(0.0, 0.0, [0, 1, 2], 4, 2)]),
    ],
)
def test_worked_cases(spark, times, users, expected):
    found = zones_of(make_events(spark, simple(times, users)), PanelSettings())
    assert [z[2:] for z in found] == expected


@pytest.mark.parametrize(
    "layout,seed,n,min_users,min_changes",
    [
        ("plain", 1, 200, 2, 4),
        ("plain", 2, 120, 2, 5),
        ("plain", 3, 160, 3, 4),
        ("plain", 5, 150, 1, 3),
        ("sliced", 1, 200, 2, 4),
        ("chained", 2, 120, 2, 5),
        ("sliced and chained", 3, 160, 3, 4),
    ],
)
def test_zones_equal_the_sequential_rule(spark, layout, seed, n, min_users, min_changes):
    rows = random_rows(seed, n, span=150.0)
    settings = PanelSettings(
        shared_params=("frequency", "offset"), min_users=min_users, min_changes=min_changes, **LAYOUTS[layout]
    )
    expected = []
    for param in ("frequency", "offset"):
        changes = [(t, u) for t, u, p, *_ in canonical(rows) if p == param]
        found = brute.zones(changes, 5.0, min_changes, min_users, 2.0)
        expected += [(param, k, s, e, us, nc, sw) for k, (s, e, us, nc, sw) in enumerate(found, 1)]
    assert expected
    assert zones_of(make_events(spark, rows), settings) == expected


@pytest.mark.parametrize("layout", ["plain", "chained"])
def test_dense_fight_in_one_long_chain(spark, layout):
    rows = [(k * 0.7, k % 3, k, "frequency") for k in range(300)]
    settings = PanelSettings(merge_gap=0.5, **LAYOUTS[layout])
    changes = [(t, u) for t, u, *_ in canonical(rows)]
    expected = [("frequency", k, *z) for k, z in enumerate(brute.zones(changes, gap=0.5), 1)]
    assert len(expected) > 30
    assert zones_of(make_events(spark, rows), settings) == expected


@pytest.mark.parametrize("layout", ["plain", "sliced"])
@pytest.mark.parametrize("min_users", [2, 3])
def test_candidates_are_the_qualifying_first_changes(spark, layout, min_users):
    rows = random_rows(11, 180, params=("frequency",))
    changes = [(t, u) for t, u, *_ in canonical(rows)]
    expected, last = [], None
    for start, end, n, turns, users, _ in brute.windows(changes, 5.0):
        if start != last and n >= 4 and turns >= min_users and len(users) >= min_users:
            expected.append((start, end, n, turns))
        last = start
    settings = PanelSettings(min_users=min_users, **LAYOUTS[layout])
    found = conflict_candidates(make_events(spark, rows), settings).orderBy("start_time").collect()
    assert [(r.start_time, r.end_time, r.num_changes, r.user_switches) for r in found] == expected


def test_zones_keep_their_distance(spark):
    rows = random_rows(7, 400, params=("frequency",), span=300.0)
    found = zones_of(make_events(spark, rows), PanelSettings())
    assert all(z[5] >= 4 and z[6] >= 2 for z in found)
    assert all(b[2] - a[3] > 2.0 for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("layout", ["plain", "sliced"])
def test_zone_values_equal_a_scan_of_the_grid(spark, layout):
    rows = random_rows(23, 200, params=("frequency",), span=120.0)
    settings = PanelSettings(**LAYOUTS[layout])
    events = make_events(spark, rows)
    ordered = canonical(rows)
    ticks = brute.grid([r[0] for r in ordered], 0.1)
    values = brute.as_of(ticks, [(r[0], r[5]) for r in ordered])
    known = [v for v in values if v is not None]
    expected = []
    for number, (start, end, *_ ) in enumerate(brute.zones([(r[0], r[1]) for r in ordered]), 1):
        inside = [v for t, v in zip(ticks, values) if start <= t <= end and v is not None]
        if inside:
            expected.append((number, min(inside), max(inside), min(known), max(known)))
    zones = detect_conflicts(events, settings)
    stats = zone_value_stats(zones, events, settings)
    found = sorted((r.zone_no, r.value_min, r.value_max, r.series_min, r.series_max) for r in stats.collect())
    assert found == expected and len(found) >= 3


def test_annotations_and_report(spark):
    events = make_events(spark, [(0, 0, 1), (1, 1, 2), (2, 0, 4), (3, 1, 3), (30, 0, 11), (40, 0, 0)])
    zones = detect_conflicts(events)
    note = conflict_annotations(zone_value_stats(zones, events)).first()
    assert (note.center_time, note.center_value) == (1.5, 2.5)
    assert note.width == pytest.approx(3.9) and note.height == pytest.approx(4.5)
    assert note.label_value == pytest.approx(4.9)
    line = conflict_report(zones).first()
    assert (line.zone_no, line.span, line.users_involved) == (1, "0.0s - 3.0s", "0, 1")


def test_a_zone_without_ticks_drops_out(spark):
    # All changes lie at the very end, which the half-open grid leaves out.
    events = make_events(spark, [(0, 0, 1, "offset"), (9.95, 0, 1), (9.95, 1, 2), (9.95, 2, 1), (9.95, 3, 2)])
    zones = detect_conflicts(events)
    assert zones.count() == 1
    assert zone_value_stats(zones, events).count() == 0


def test_large_and_small_sessions_side_by_side(spark):
    from tugboard.operators.activity import inactivity_gaps
    from tugboard.operators.carefulness import carefulness
    from tugboard.operators.segments import change_segments

    frames = [
        make_events(spark, random_rows(41, 150, span=60.0), "big"),
        make_events(spark, random_rows(42, 30, span=15.0), "small"),
    ]
    events = frames[0].unionByName(frames[1])
    mixed = PanelSettings(shared_params=("frequency", "offset"), hot_rows=15, slice_rows=9)
    plain = PanelSettings(shared_params=("frequency", "offset"))
    for operator in (detect_conflicts, inactivity_gaps, carefulness, change_segments):
        found = [
            sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in operator(events, s).collect()), key=str)
            for s in (mixed, plain)
        ]
        assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("layout", [dict(hot_rows=20, slice_rows=8), dict(hot_rows=5, slice_rows=3, broadcast_rows=0)])
def test_many_hot_groups_give_the_plain_answer(spark, layout):
    wide = [(t, (t + k) % 3, t, f"p{k}") for k in range(4) for t in range(12)]
    narrow = [(t, u, t, "frequency") for t in range(12) for u in range(3)]
    events = make_events(spark, wide, "A").unionByName(make_events(spark, narrow, "B"))
    params = ("frequency", "p0", "p1", "p2", "p3")

    def answers(**numbers):
        settings = PanelSettings(shared_params=params, **numbers)
        found = sorted(map(tuple, conflict_candidates(events, settings).collect()), key=repr)
        return found, sorted(zones_of(events, settings), key=repr)

    expected = answers()
    assert expected[0] and answers(**layout) == expected


@pytest.mark.parametrize("layout", [{}, dict(hot_rows=20, slice_rows=30, broadcast_rows=2)])
def test_long_zones_over_many_levels_of_the_pyramid(spark, layout):
    """Zones of any length and place, blocks of two ticks, against every tick looked at."""
    import random

    rng = random.Random(8)
    rows = [(round(rng.uniform(3, 400), 2), rng.randrange(3), rng.gauss(0, 100), "frequency") for _ in range(500)] + [(0.0, 0, 1.0, "gain"), (400.0, 0, 1.0, "gain")]
    events = make_events(spark, rows)
    settings = PanelSettings(conflict_window=0.2, **layout)
    cuts = [tuple(sorted((round(rng.uniform(-1, 410), 2), round(rng.uniform(-1, 410), 2)))) for _ in range(80)]
    cuts += [(5.0, 5.0), (0.0, 400.0), (0.0, 2.0), (401.0, 402.0), (100.0, 100.05), (51.2, 102.4)]
    zones = spark.createDataFrame([("all", "frequency", k, *cut) for k, cut in enumerate(cuts)], "session_id string, param string, zone_no long, start_time double, end_time double")
    got = {r.zone_no: (r.value_min, r.value_max) for r in zone_value_stats(zones, events, settings).collect()}
    ticks = [(r.t, r.value) for r in merged_series(events, settings).where("param = 'frequency' and value is not null").collect()]
    expected = {}
    for k, (start, end) in enumerate(cuts):
        seen = [value for t, value in ticks if start <= t <= end]
        if seen:
            expected[k] = (min(seen), max(seen))
    assert got == expected

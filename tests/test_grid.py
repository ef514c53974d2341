from __future__ import annotations

import pytest
from conftest import canonical, make_events, random_rows

import brute
from tugboard.config import PanelSettings
from tugboard.operators.activity import most_dominant_user, time_in_control
from tugboard.operators.grid import locf_series, merged_series, ownership_segments, series_wide
from tugboard.operators.roster import session_bounds
from tugboard.operators.views import param_page, select_view, time_viewport

SHARED = PanelSettings(shared_params=("frequency", "offset"))
SALTED = PanelSettings(shared_params=("frequency", "offset"), broadcast_rows=0, fan_out=4)
LARGE = PanelSettings(shared_params=("frequency", "offset"), hot_rows=10)


@pytest.fixture(scope="module", params=[(1, True), (2, False)])
def session(spark, request):
    seed, tenth = request.param
    rows = random_rows(seed, 60, users=3, span=12.0, tenth=tenth)
    rows.append((3.3, 0, 9, "gain"))  # a parameter with a single change
    ordered = canonical(rows)
    ticks = brute.grid([r[0] for r in ordered], 0.1)
    return make_events(spark, rows), ordered, ticks


def test_bounds(session):
    events, ordered, ticks = session
    row = session_bounds(events).first()
    assert (row.t_min, row.t_max, row.n_ticks) == (ordered[0][0], ordered[-1][0], len(ticks))


@pytest.mark.parametrize("settings", [SHARED, SALTED, LARGE], ids=["broadcast", "salted", "large"])
def test_merged_series(session, settings):
    events, ordered, ticks = session
    expected = {}
    for param in ("frequency", "offset", "gain"):
        held = brute.as_of(ticks, [(t, (v, u)) for t, u, p, _, _, v in ordered if p == param])
        for i, (t, h) in enumerate(zip(ticks, held)):
            expected[param, i] = (t, *(h or (None, None)))
    found = {(r.param, r.i): (r.t, r.value, r.owner) for r in merged_series(events, settings).collect()}
    assert found == expected


@pytest.mark.parametrize("settings", [SHARED, LARGE], ids=["small", "large"])
def test_locf_series_wide_and_views(session, settings):
    events, ordered, ticks = session
    expected = {}
    for param in ("frequency", "offset", "gain"):
        for user in range(3):
            held = brute.as_of(ticks, [(t, v) for t, u, p, _, _, v in ordered if p == param and u == user])
            expected.update({(param, user, i): (t, v) for i, (t, v) in enumerate(zip(ticks, held))})
    rows = locf_series(events, settings).collect()
    assert {(r.param, r.user, r.i): (r.t, r.value) for r in rows} == expected and len(rows) == len(expected)

    wide = series_wide(events, range(3), settings).collect()
    assert len(wide) == len(ticks) * 3
    for r in wide:
        assert [r.user_0, r.user_1, r.user_2] == [expected[r.param, u, r.i][1] for u in range(3)]

    view = select_view(events, [0, 2], ["gain", "offset"], settings).collect()
    assert {(r.param, r.user, r.i): (r.t, r.value) for r in view} == {
        k: v for k, v in expected.items() if k[0] != "frequency" and k[1] != 1
    }
    start = ticks[10]
    for begin, shown in ((None, ticks[0]), (start, start), (start + 0.03, start + 0.03)):
        part = time_viewport(events, begin, settings=PanelSettings(viewport=2.0)).collect()
        assert {(r.param, r.user, r.i): (r.t, r.value) for r in part} == {
            k: v for k, v in expected.items() if shown <= v[0] <= shown + 2.0
        }
    assert time_viewport(events, full=True).count() == len(expected)


def test_empty_choice_shows_nothing(session):
    events, *_ = session
    assert select_view(events, [], ["gain"]).count() == 0
    assert select_view(events, [0], []).count() == 0


def test_ownership_and_control(session):
    events, ordered, ticks = session
    segments, seconds = [], {}
    for param in ("frequency", "offset"):
        owners = brute.as_of(ticks, [(t, u) for t, u, p, *_ in ordered if p == param])
        segments += [(param, u, ticks[a], ticks[b], b - a + 1) for a, b, u in brute.runs_of(owners)]
        for user in range(3):
            seconds[param, user] = owners.count(user) * 0.1
    rows = ownership_segments(events, SHARED).collect()
    assert sorted((r.param, r.owner, r.start_time, r.end_time, r.ticks) for r in rows) == sorted(segments)
    assert ownership_segments(events, SHARED, users=[1]).count() == sum(s[1] == 1 for s in segments)

    duration = ordered[-1][0] - ordered[0][0]
    control = time_in_control(events, SHARED).collect()
    assert {(r.param, r.user): r.control_seconds for r in control} == pytest.approx(seconds)
    assert {(r.param, r.user): r.control_percent for r in control} == pytest.approx(
        {k: s / duration * 100 for k, s in seconds.items()}
    )
    best = {r.param: r.user for r in most_dominant_user(events, SHARED).collect()}
    assert best == {
        p: max(range(3), key=lambda u: (seconds[p, u], -u)) for p in ("frequency", "offset")
    }


def test_worked_dominance(spark):
    events = make_events(spark, [(0, 0, 1), (1, 1, 2), (2, 0, 3)])
    rows = {r.user: (r.control_seconds, r.control_percent) for r in time_in_control(events).collect()}
    assert rows == {0: (1.0, 50.0), 1: (1.0, 50.0)}
    assert most_dominant_user(events).first().user == 0
    assert merged_series(events).count() == 20


def test_one_instant_has_no_grid(spark):
    events = make_events(spark, [(5, 0, 1), (5, 1, 2)])
    assert session_bounds(events).first().n_ticks == 0
    assert merged_series(events).count() == 0 and locf_series(events).count() == 0
    assert [(r.control_seconds, r.control_percent) for r in time_in_control(events).collect()] == [(0.0, 0.0)] * 2


def test_sessions_have_their_own_grids(spark):
    sessions = {"early": [(0, 0, 1), (1, 1, 2)], "late": [(100.05, 0, 1), (100.55, 1, 2), (101.05, 1, 2)]}
    expected = {}
    for name, rows in sessions.items():
        owners = brute.as_of(brute.grid([r[0] for r in rows], 0.1), [(r[0], r[1]) for r in rows])
        expected.update({(name, u): owners.count(u) * 0.1 for u in (0, 1)})
    events = make_events(spark, sessions["early"], "early").unionByName(make_events(spark, sessions["late"], "late"))
    rows = {(r.session_id, r.user): r.control_seconds for r in time_in_control(events).collect()}
    assert rows == pytest.approx(expected) and len(set(rows.values())) > 2


@pytest.mark.parametrize("offset,names", [(0, ["a", "b"]), (1, ["b", "c"]), (9, ["b", "c"])])
def test_param_page(spark, offset, names):
    events = make_events(spark, [(k, 0, 1, p) for k, p in enumerate("cab")])
    assert [r.param for r in param_page(events, offset).orderBy("place").collect()] == names


def test_param_page_of_a_short_list(spark):
    assert [r.param for r in param_page(make_events(spark, [(0, 0, 1, "a")]), 3).collect()] == ["a"]


def test_large_and_small_sessions_side_by_side(spark):
    sessions = {"big": random_rows(31, 80, users=2, span=9.0), "small": random_rows(32, 12, users=2, span=9.0)}
    frames = [make_events(spark, rows, name) for name, rows in sessions.items()]
    events = frames[0].unionByName(frames[1])
    mixed = PanelSettings(shared_params=("frequency", "offset"), hot_rows=30)
    plain = PanelSettings(shared_params=("frequency", "offset"))
    for operator in (merged_series, locf_series, ownership_segments):
        assert sorted(operator(events, mixed).collect(), key=str) == sorted(operator(events, plain).collect(), key=str)

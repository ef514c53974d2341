from __future__ import annotations

import pytest
from conftest import canonical, make_events, random_rows

from tugboard.config import PanelSettings
from tugboard.operators import activity, roster
from tugboard.operators.segments import change_segments, change_segments_preview

LAYOUTS = [PanelSettings(), PanelSettings(hot_rows=10, slice_rows=6)]
IDS = ["plain", "sliced"]


@pytest.fixture(scope="module")
def session(spark):
    rows = random_rows(4, 90, users=3, params=("frequency", "offset", "gain"), span=200.0)
    rows = [r if r[1] else (r[0], 0, r[2], "offset") for r in rows]  # user 0 only touches one
    return make_events(spark, rows), canonical(rows)


def by_user(ordered):
    out = {}
    for row in ordered:
        out.setdefault(row[1], []).append(row)
    return out


@pytest.mark.parametrize("settings", LAYOUTS, ids=IDS)
def test_full_record(session, settings):
    events, ordered = session
    duration = ordered[-1][0] - ordered[0][0]
    found = {r.user: r for r in activity.user_activity(events, settings).collect()}
    for user, rows in by_user(ordered).items():
        times = [r[0] for r in rows]
        gaps = [b - a for a, b in zip(times, times[1:])]
        r = found[user]
        assert r.total_changes == len(rows)
        assert r.changes_per_minute == pytest.approx(len(rows) / duration * 60)
        assert r.param_changes == {p: sum(x[2] == p for x in rows) for p in ("frequency", "offset", "gain")}
        assert r.max_inactivity_gap == max(gaps)
        assert r.avg_gap_between_changes == pytest.approx(sum(gaps) / len(gaps))
        assert r.long_inactivity_periods == sum(g > 10 for g in gaps)
        assert (r.first_action_time, r.last_action_time) == (times[0], times[-1])
        assert r.active_duration == times[-1] - times[0]
        assert r.activity_percentage == pytest.approx((times[-1] - times[0]) / duration * 100)
    assert set(found[0].time_in_control) == {"frequency"} and found[0].time_in_control["frequency"] == 0.0
    # Owned seconds add up to the ticks that have an owner.
    ticks = [r for r in __import__("brute").grid([x[0] for x in ordered], 0.1)
             if r >= min(x[0] for x in ordered if x[2] == "frequency")]
    assert sum(r.time_in_control["frequency"] for r in found.values()) == pytest.approx(len(ticks) * 0.1)


@pytest.mark.parametrize("settings", LAYOUTS, ids=IDS)
def test_worked_gaps(spark, settings):
    events = make_events(spark, [(0, 0, 1), (10, 0, 2, "offset"), (20.5, 0, 3), (7, 1, 1)])
    rows = {r.user: tuple(r)[2:] for r in activity.inactivity_gaps(events, settings).collect()}
    assert rows == {0: (10.5, 10.25, 1), 1: (0.0, 0.0, 0)}


def test_equal_times_have_no_gap(spark):
    events = make_events(spark, [(5, 0, 1), (5, 0, 2), (25, 1, 1)])
    rows = {r.user: tuple(r)[2:] for r in activity.inactivity_gaps(events).collect()}
    assert rows == {0: (0.0, 0.0, 0), 1: (0.0, 0.0, 0)}


def test_zero_duration(spark):
    events = make_events(spark, [(5, 0, 1), (5, 1, 2)])
    assert {r.changes_per_minute for r in roster.user_change_counts(events).collect()} == {0.0}
    assert {r.activity_percentage for r in activity.activity_span(events).collect()} == {0.0}


def test_ties_go_to_the_smallest_user(spark):
    events = make_events(spark, [(k, u, k, "offset") for k, u in enumerate([1, 0, 2, 0, 1, 1, 0])])
    assert tuple(activity.most_active_user(events).first()) == ("all", 0, 3)
    assert activity.most_responsive_user(events).first().user == 0
    assert activity.most_dominant_user(events).count() == 0  # no shared parameter in the session


def test_shares_and_bars(session):
    events, ordered = session
    rows = activity.engagement_distribution(events).collect()
    assert sum(r.engagement_percent for r in rows) == pytest.approx(100)
    for r in rows:
        full = int(r.engagement_percent / 2)
        assert r.bar == "█" * full and r.panel_bar == "█" * full + "░" * (50 - full)
    dense = roster.param_change_counts(events).collect()
    assert len(dense) == 9
    zero = [r for r in dense if r.user == 0 and r.param != "offset"]
    assert [(r.changes, r.share_percent) for r in zero] == [(0, 0.0)] * 2
    assert sum(r.share_percent for r in dense if r.user == 1) == pytest.approx(100)


def test_rosters(session):
    events, ordered = session
    assert sorted(r.user for r in roster.distinct_users(events).collect()) == [0, 1, 2]
    appearance = list(dict.fromkeys(r[2] for r in ordered))
    assert [r.param for r in roster.distinct_params(events).orderBy("position").collect()] == appearance


@pytest.mark.parametrize("settings", LAYOUTS, ids=IDS)
def test_change_segments(session, settings):
    events, ordered = session
    from conftest import clock

    expected, last = [], {}
    for t, u, p, _, _, v in sorted(ordered, key=lambda r: (r[1], r[2], clock(r[0]), r[3], r[4])):
        if (u, p) in last and last[u, p][1] != v:
            expected.append((u, p, last[u, p][0], clock(t), last[u, p][1], v))
        last[u, p] = (clock(t), v)
    rows = change_segments(events, settings).collect()
    assert sorted(tuple(r)[1:] for r in rows) == sorted(expected) and expected
    preview = [tuple(r)[1:] for r in change_segments_preview(events, settings).collect()]
    assert preview == sorted(expected, key=lambda s: (s[0], s[1], s[3], s[2], s[4], s[5]))[:10]


def test_a_segment_starts_at_the_event_before(spark):
    events = make_events(spark, [(1, 0, 1), (2, 0, 1), (3, 0, 2)])
    (row,) = change_segments(events).collect()
    assert tuple(row)[3:] == ("00:00:02.000000", "00:00:03.000000", 1.0, 2.0)

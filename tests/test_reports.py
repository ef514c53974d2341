from __future__ import annotations

import pytest
from conftest import make_events

from tugboard.config import PanelSettings
from tugboard.operators.reports import comparative_report, session_overview, session_report, stats_panel

ROWS = [(0, 0, 1), (1, 1, 2), (2, 0, 3), (60, 1, 2, "phase shift"), (120, 2, 4, "phase shift"), (120, 2, 5, "phase shift")]


def test_overview(spark):
    row = session_overview(make_events(spark, ROWS)).first()
    assert tuple(row) == ("all", 120.0, 2.0, "Frequency, Phase shift")


def test_session_report_has_a_row_per_user_and_parameter(spark):
    rows = {(r.user, r.param): r for r in session_report(make_events(spark, ROWS)).collect()}
    assert len(rows) == 6
    first = rows[0, "frequency"]
    assert (first.changes, first.share_percent, first.control_seconds) == (2, 100.0, pytest.approx(119.0))
    assert rows[0, "phase shift"].changes == 0 and rows[0, "phase shift"].control_seconds is None
    assert rows[2, "frequency"].control_seconds == 0.0
    assert rows[2, "phase shift"].param_label == "Phase shift"
    assert rows[1, "frequency"].active_minutes == pytest.approx(59 / 60)


def test_comparative_report(spark):
    rows = {r.user: r for r in comparative_report(make_events(spark, ROWS)).collect()}
    assert len(rows) == 3
    for r in rows.values():
        assert (r.most_active_user, r.most_changes, r.most_responsive_user) == (0, 2, 0)
        assert (r.dominant_user, r.dominant_seconds) == (0, pytest.approx(119.0))
        assert r.dominant_percent == pytest.approx(119 / 120 * 100)
    assert rows[2].engagement_percent == pytest.approx(100 / 3)
    assert rows[1].label == "Insufficient data"


def test_comparative_report_has_every_shared_parameter(spark):
    events = make_events(spark, [(0, 0, 1, "frequency"), (2, 1, 2, "gain"), (9, 0, 3, "frequency")])
    rows = comparative_report(events, PanelSettings(shared_params=("frequency", "gain"))).collect()
    assert sorted((r.user, r.dominant_param, r.dominant_user) for r in rows) == [
        (0, "frequency", 0), (0, "gain", 1), (1, "frequency", 0), (1, "gain", 1)
    ]


def test_without_a_shared_parameter(spark):
    rows = comparative_report(make_events(spark, [(0, 0, 1, "gain"), (5, 1, 2, "gain")])).collect()
    assert [r.dominant_user for r in rows] == [None, None]


def test_stats_panel(spark):
    lines = {r.user: r.line for r in stats_panel(make_events(spark, ROWS)).collect()}
    assert lines[0] == "User 0: 2 changes  |  1.0 chg/min  |  Frequency dominance: 99.2%  |  Max gap: 2.0s"
    bare = stats_panel(make_events(spark, [(0, 0, 1, "gain"), (8, 0, 2, "gain")])).first().line
    assert bare == "User 0: 2 changes  |  15.0 chg/min  |  Max gap: 8.0s"

"""Synchrony of pairs against the correlation of spelled-out series."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from conftest import make_events, random_rows

from tugboard.config import PanelSettings
from tugboard.operators.grid import locf_series
from tugboard.operators.synchrony import pairwise_synchrony


def by_ticks(events):
    series = {}
    for r in locf_series(events).collect():
        series.setdefault((r.session_id, r.param, r.user), {})[r.i] = r.value
    found = {}
    for (session, param, a), (other, same, b) in combinations(sorted(series), 2):
        if (session, param) == (other, same):
            one, two = series[session, param, a], series[session, param, b]
            both = [(one[i], two[i]) for i in one if one[i] is not None and two[i] is not None]
            x, y = np.array(both).T if both else (np.zeros(0), np.zeros(0))
            varies = len(both) and x.min() < x.max() and y.min() < y.max()
            found[session, param, a, b] = (len(both), float(np.corrcoef(x, y)[0, 1]) if varies else None)
    return found


@pytest.mark.parametrize("layout", [{}, dict(hot_rows=20, slice_rows=30, broadcast_rows=1, fan_out=3)])
def test_pairs(spark, layout):
    rows = random_rows(5, 300, users=5) + [(59.0, 7, 1e9), (59.5, 7, 1e9 + 1)] + [(1.0 + k, 6, 4.0) for k in range(9)]
    events = make_events(spark, rows).unionByName(make_events(spark, random_rows(6, 40, tenth=False), "two"))
    got = {tuple(r)[:4]: tuple(r)[4:] for r in pairwise_synchrony(events, PanelSettings(**layout)).collect()}
    expected = by_ticks(events)
    assert set(got) == set(expected) and len(got) > 40
    for pair, (ticks, correlation) in expected.items():
        assert got[pair][0] == ticks and got[pair][1] == (correlation if correlation is None else pytest.approx(correlation, abs=1e-9)), pair


def test_known_pairs(spark):
    rows = [(0.0, 0, 1), (0.0, 1, 10), (0.0, 2, 5), (0.0, 3, -1), (1.0, 0, 2), (1.0, 1, 20), (1.0, 3, -2), (2.0, 0, 1, "other"), (3.0, 4, 1)]
    found = {(r.param, r.user_a, r.user_b): (r.common_ticks, r.correlation) for r in pairwise_synchrony(make_events(spark, rows)).collect()}
    assert found["frequency", 0, 1] == (30, pytest.approx(1.0)) and found["frequency", 0, 3] == (30, pytest.approx(-1.0))
    assert found["frequency", 0, 2] == (30, None)    # a constant series
    assert found["frequency", 0, 4] == (0, None)     # the last change lies behind the grid
    assert found["other", 0, 1] == (0, None)
    assert pairwise_synchrony(make_events(spark, rows).limit(0)).count() == 0

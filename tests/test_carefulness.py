from __future__ import annotations

import pytest
from conftest import canonical, make_events, random_rows

from tugboard.config import PanelSettings
from tugboard.operators.carefulness import carefulness, carefulness_summary
from tugboard.operators.reports import carefulness_lines, carefulness_report

LAYOUTS = [PanelSettings(), PanelSettings(hot_rows=10, slice_rows=7)]


def values(*numbers, user=0, param="frequency"):
    return [(float(k), user, v, param) for k, v in enumerate(numbers)]


@pytest.mark.parametrize(
    "rows,expected",
    [
        (values(*range(11)), (1.0, 1.0, 100.0, "Careful")),
        (values(0, 1, 2, 12), (4.0, 10.0, pytest.approx(200 / 3), "Reckless")),
        (values(5, 5, 5), (0.0, 0.0, 0.0, "Careful (no variation)")),
        (values(5), (None, None, None, "Insufficient data")),
        # seven of ten small steps: exactly 70 percent is not above it
        (values(0, 1, 2, 3, 4, 5, 6, 7, 100, 0, 100), (pytest.approx(30.0), 100.0, 70.0, "Reckless")),
    ],
)
def test_worked_cases(spark, rows, expected):
    row = carefulness(make_events(spark, rows)).first()
    assert tuple(row)[3:] == expected


@pytest.mark.parametrize("settings", LAYOUTS, ids=["plain", "sliced"])
def test_measures_equal_the_sequential_rule(spark, settings):
    rows = random_rows(8, 150, users=3, span=20.0)
    series = {}
    for t, u, p, _, _, v in canonical(rows):
        series.setdefault((u, p), []).append(v)
    found = {(r.user, r.param): tuple(r)[3:] for r in carefulness(make_events(spark, rows), settings).collect()}
    assert set(found) == set(series)
    for key, seen in series.items():
        steps = [abs(b - a) for a, b in zip(seen, seen[1:])]
        small = sum(s <= 0.1 * (max(seen) - min(seen)) for s in steps) / len(steps) * 100
        label = "Careful" if small > 70 else "Reckless"
        assert found[key] == (pytest.approx(sum(steps) / len(steps)), max(steps), pytest.approx(small), label)


def test_summary_counts_exactly_seventy_as_careful(spark):
    careful = [r for p in "abcdefg" for r in values(1, 1, param=p)]
    reckless = [r for p in "hij" for r in values(0, 1, 2, 12, param=p)]
    lonely = values(3, user=1, param="a")
    events = make_events(spark, careful + reckless + lonely)
    rows = {r.user: (r.careful_percent, r.label) for r in carefulness_summary(events).collect()}
    assert rows == {0: (pytest.approx(70.0), "Careful"), 1: (None, "Insufficient data")}
    assert [r.user for r in carefulness_summary(events, skip_without_data=True).collect()] == [0]


def test_report_of_one_user_and_its_lines(spark):
    events = make_events(spark, values(0, 1, 2, 12) + values(1, user=1, param="phase shift"))
    report = carefulness_report(events)
    assert report.count() == 4
    one = carefulness_report(events, user=0)
    assert sorted(r.param_label for r in one.collect()) == ["Frequency", "Phase shift"]
    lines = {r.param: r.line for r in carefulness_lines(one).collect()}
    assert lines == {
        "frequency": "Avg Δ=4.000 | Max Δ=10.000 | Careful Steps=66.7% | Behavior=Reckless",
        "phase shift": "Insufficient data",
    }

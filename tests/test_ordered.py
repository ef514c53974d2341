"""Slices give the same neighbours and totals as plain windows, wherever the cuts fall."""

from __future__ import annotations

import random

import pytest

from tugboard.config import PanelSettings
from tugboard.plans.joins import attach_facts
from tugboard.plans.ordered import order_groups


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for number in range(3000):
        # One group holds most rows, and half of those share one instant.
        key = "hot" if rng.random() < 0.7 else rng.choice("abc")
        t = 5.0 if rng.random() < 0.5 else rng.randrange(50) / 2
        data.append((key, t, number, rng.choice([None, 1, 2, 3]), rng.randrange(10)))
    return data, spark.createDataFrame(data, "k string, t double, id long, v int, n int")


def expected(data):
    groups = {}
    for row in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    out = set()
    for key, members in groups.items():
        total, best = 0, None
        low = min(m[4] for m in members)
        for i, (_, t, number, v, n) in enumerate(members):
            total += n
            best = n if best is None else max(best, n)
            before = members[i - 1][3] if i else None
            before_id = members[i - 1][2] if i else None
            after_id = members[i + 1][2] if i + 1 < len(members) else None
            out.add((key, t, number, before, before_id, after_id, total, best, low))
    return out


@pytest.mark.parametrize("hot,slice_rows", [(10_000, 100), (1500, 100), (1500, 20), (100, 37), (1, 200)])
def test_neighbours_and_totals(rows, hot, slice_rows):
    data, frame = rows
    settings = PanelSettings(hot_rows=hot, slice_rows=slice_rows)
    groups = order_groups(frame, ["k"], ["t", "id"], settings)
    assert groups.sliced == (hot < 10_000)
    result = (
        groups.previous(before="v", before_id="id")
        .following(after_id="id")
        .running(total=("sum", "n"), best=("max", "n"))
        .whole(low=("min", "n"))
        .done()
        .select("k", "t", "id", "before", "before_id", "after_id", "total", "best", "low")
    )
    got = [tuple(r) for r in result.collect()]
    assert len(got) == len(data)
    assert set(got) == expected(data)


def test_slices_split_a_hot_instant(rows):
    _, frame = rows
    groups = order_groups(frame, ["k"], ["t", "id"], PanelSettings(hot_rows=1500, slice_rows=100))
    sizes = groups.frame.where("_slice >= 0").groupBy("_slice").count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 600


def test_salted_join_equals_broadcast(spark, rows):
    _, frame = rows
    facts = frame.groupBy("k").count()
    wide = attach_facts(frame, facts, ["k"], ["id"], 4, PanelSettings())
    salted = attach_facts(frame, facts, ["k"], ["id"], 4, PanelSettings(broadcast_rows=3, fan_out=8))
    assert sorted(wide.collect(), key=str) == sorted(salted.select(*wide.columns).collect(), key=str)

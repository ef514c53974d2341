from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tugboard.functions.cells import bar, fixed, padded_bar, per_minute, share_percent, title_case
from tugboard.functions.clock import first_tick_beyond, first_tick_from, seconds_of_day, tick_count, tick_step


@pytest.mark.parametrize("decimals", [1, 2, 3])
def test_fixed_prints_like_the_language(spark, decimals):
    rng = random.Random(decimals)
    numbers = [0.0, 0.05, 0.25, 0.35, 2.675, 1.005, 6.25, 18.75, 12.3405, 99.95, 0.9995, 1704079804.729045, -6.25]
    numbers += [rng.uniform(0, 1000) for _ in range(300)]
    numbers += [rng.randrange(20000) / 2 / 10**decimals / 10 for _ in range(600)]
    frame = spark.createDataFrame([(x,) for x in numbers], "x double")
    for r in frame.select("x", fixed(F.col("x"), decimals).alias("text")).collect():
        assert r.text == f"{r.x:.{decimals}f}"


def test_ticks_match_a_scan(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        t_min = rng.choice([0.0, 36000.1, rng.uniform(0, 90000)])
        t = t_min + rng.choice([rng.randrange(60) / 10, rng.uniform(0, 6)])
        rows.append((t_min, t))
    step = tick_step(F.col("t_min"), 0.1)
    frame = spark.createDataFrame(rows, "t_min double, t double").select(
        "*",
        step.alias("step"),
        first_tick_from(F.col("t"), F.col("t_min"), step).alias("at"),
        first_tick_beyond(F.col("t"), F.col("t_min"), step).alias("beyond"),
        tick_count(F.col("t_min"), F.col("t_min") + 1.0, 0.1).alias("n"),
    )
    for r in frame.collect():
        assert r.step == (r.t_min + 0.1) - r.t_min
        ticks = [r.t_min + i * r.step for i in range(80)]
        assert r["at"] == next(i for i, x in enumerate(ticks) if x >= r.t)
        assert r.beyond == next(i for i, x in enumerate(ticks) if x > r.t)


def test_small_helpers(spark):
    frame = spark.createDataFrame([("10:02:03.25", "pHase shift", 37.9)], "t string, p string, pct double")
    row = frame.select(
        seconds_of_day(F.col("t")),
        title_case(F.col("p")),
        bar(F.col("pct")),
        F.length(padded_bar(F.col("pct"))),
        share_percent(F.lit(1), F.lit(0.0)),
        per_minute(F.lit(3), F.lit(90.0)),
    ).first()
    assert tuple(row) == (36123.25, "Phase shift", "█" * 18, 50, 0.0, 2.0)

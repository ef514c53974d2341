"""Time-of-day text and tick arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of_day(text: Column) -> Column:
    """``HH:MM:SS.f`` to seconds since midnight; no date, so no rollover."""
    parts = F.split(text, ":")
    whole = parts[0].cast("int") * 3600 + parts[1].cast("int") * 60
    return whole + parts[2].cast("double")


def tick_step(t_min: Column, tick: float) -> Column:
    """Distance between ticks: the rounded difference, not the nominal resolution."""
    return (t_min + F.lit(tick)) - t_min


def tick_count(t_min: Column, t_max: Column, tick: float) -> Column:
    return F.ceil((t_max - t_min) / F.lit(tick)).cast("long")


def tick_time(i: Column, t_min: Column, step: Column) -> Column:
    return t_min + i * step


def first_tick_from(t: Column, t_min: Column, step: Column) -> Column:
    """Index of the first tick at or after ``t``; the guess is corrected by one where it rounds."""
    guess = F.ceil((t - t_min) / step).cast("long")
    exact = (
        F.when(tick_time(guess - 1, t_min, step) >= t, guess - 1)
        .when(tick_time(guess, t_min, step) >= t, guess)
        .otherwise(guess + 1)
    )
    return F.greatest(exact, F.lit(0).cast("long"))


def first_tick_beyond(t: Column, t_min: Column, step: Column) -> Column:
    """Index of the first tick strictly after ``t``."""
    guess = F.floor((t - t_min) / step).cast("long") + 1
    exact = (
        F.when(tick_time(guess, t_min, step) <= t, guess + 1)
        .when(tick_time(guess - 1, t_min, step) <= t, guess)
        .otherwise(guess - 1)
    )
    return F.greatest(exact, F.lit(0).cast("long"))

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tugboard.session import local_session  # noqa: E402

EVENT_SCHEMA = (
    "session_id string, file string, block_start long, mid long, time string, "
    "user int, param string, value double, time_sec double"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


def clock(seconds: float) -> str:
    minutes, rest = divmod(seconds, 60)
    return f"{int(minutes) // 60:02d}:{int(minutes) % 60:02d}:{rest:09.6f}"


def make_events(spark, rows, session="all"):
    """Rows of (time_sec, user, value) or (time_sec, user, value, param), in line order."""
    full = []
    for number, row in enumerate(rows):
        t, user, value, *param = row
        full.append((session, f"User{user}.log", 0, number, clock(t), user, param[0] if param else "frequency", float(value), float(t)))
    return spark.createDataFrame(full, EVENT_SCHEMA)


def random_rows(seed: int, n: int, users: int = 4, params=("frequency", "offset"), span: float = 60.0, tenth: bool = True):
    """Random changes with many equal times."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        t = rng.uniform(0, span)
        rows.append((
            round(t, 1) if tenth else t,
            rng.randrange(users),
            rng.choice([1, 2, 2, 3, 5, 8, 13]) / 2,
            rng.choice(params),
        ))
    return rows


def canonical(rows):
    """Line numbers attached and sorted as (time, user, param, file, line)."""
    return sorted((t, u, p, f"User{u}.log", k, v) for k, (t, u, v, p) in enumerate(rows))

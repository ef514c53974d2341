"""Small sequential statements of the rules, for comparison. They share no code with the package."""

from __future__ import annotations

import math


def grid(times, tick):
    lo, hi = min(times), max(times)
    step = (lo + tick) - lo
    return [lo + i * step for i in range(math.ceil((hi - lo) / tick))]


def as_of(ticks, changes):
    """changes: (time, payload) in order; payload of the last change at or before each tick."""
    out = []
    for t in ticks:
        held = None
        for at, payload in changes:
            if at <= t:
                held = payload
        out.append(held)
    return out


def windows(changes, width):
    """changes: (time, user) in order. One (start, end, changes, turns, users) per change."""
    out = []
    for i, (t, _) in enumerate(changes):
        inside = [c for c in changes[i:] if c[0] <= t + width]
        turns = sum(a[1] != b[1] for a, b in zip(inside, inside[1:]))
        out.append((t, inside[-1][0], len(inside), turns, {u for _, u in inside}, i + len(inside)))
    return out


def picks(changes, width, min_changes, min_users):
    seen = windows(changes, width)
    out, i = [], 0
    while i < len(seen):
        start, end, n, turns, users, after = seen[i]
        if n >= min_changes and len(users) >= min_users and turns >= min_users:
            out.append((start, end, n, turns, users))
            i = after
        else:
            i += 1
    return out


def zones(changes, width=5.0, min_changes=4, min_users=2, gap=2.0):
    out = []
    for start, end, n, turns, users in picks(changes, width, min_changes, min_users):
        if out and start - out[-1][1] <= gap:
            first, _, n0, turns0, users0 = out[-1]
            out[-1] = (first, end, n0 + n, turns0 + turns, users0 | users)
        else:
            out.append((start, end, n, turns, users))
    return [(s, e, sorted(u), n, k) for s, e, n, k, u in out]


def runs_of(values):
    """(start, end inclusive, value) of maximal stretches of equal non-None values."""
    out = []
    for i, v in enumerate(values):
        if v is None:
            continue
        if out and out[-1][1] == i - 1 and out[-1][2] == v:
            out[-1] = (out[-1][0], i, v)
        else:
            out.append((i, i, v))
    return out

"""Every threshold of the analysis, and the few numbers that steer the physical layout."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PanelSettings:
    # The defaults of the analysis.
    tick: float = 0.1
    conflict_window: float = 5.0
    min_changes: int = 4
    min_users: int = 2
    merge_gap: float = 2.0
    long_gap: float = 10.0
    small_step: float = 0.1
    careful_percent: float = 70.0
    shared_params: tuple[str, ...] = ("frequency",)
    viewport: float = 50.0
    page_size: int = 2
    preview_rows: int = 10

    # Layout. None of these changes a result, only how the work is spread.
    hot_rows: int = 2_000_000       # a group with more rows is cut into range slices
    slice_rows: int = 2_000_000     # rows aimed at per slice
    broadcast_rows: int = 500_000   # a per-session table with more rows is never broadcast
    fan_out: int = 64               # salts of a shuffled join onto per-session facts
    fold_rows: int = 4096           # conflict candidates one array fold may hold
    chain_rows: int = 500_000       # conflict candidates one chain task may hold


DEFAULTS = PanelSettings()

# Two events of one session never compare equal under this order.
LINE = ("file", "block_start", "mid")
CANONICAL = ("time_sec", "user", "param", *LINE)

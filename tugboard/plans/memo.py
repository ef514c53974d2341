"""What is computed once per frame, although many operators of one report ask for it."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame

T = TypeVar("T")

# Frames are immutable. Only sizes and handles of small tables are kept, as long as the frame lives.
_known: WeakKeyDictionary[DataFrame, dict[Hashable, object]] = WeakKeyDictionary()


def remembered(frame: DataFrame, what: Hashable, compute: Callable[[], T]) -> T:
    facts = _known.setdefault(frame, {})
    if what not in facts:
        facts[what] = compute()
    return facts[what]


def recall(frame: DataFrame, what: Hashable):
    return _known.get(frame, {}).get(what)

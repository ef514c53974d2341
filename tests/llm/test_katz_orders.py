"""The Katz model of any order against a recursive statement of it."""

from __future__ import annotations

import math
import sys
import zlib
from collections import Counter, defaultdict
from functools import cache
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plain import LOWER, WORD  # noqa: E402
from test_operators import TABLES, by_id, docs, read, smallest_table, texts  # noqa: E402, F401
from tugboard.llm import katz_lm, queries  # noqa: E402


def scores(own: dict, order: int, most: int = 5) -> dict:
    tokens = {d: [" start"] * (order - 1) + WORD.findall((t or "").translate(LOWER)) + [" end"] for d, t in own.items()}
    grams = {k: Counter() for k in range(1, order + 1)}
    for d, w in tokens.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            for i in range(order - 1, len(w)):
                for k in grams:
                    grams[k][tuple(w[i - k + 1: i + 1])] += 1
    worth = {}
    for k, counts in grams.items():
        n = Counter(counts.values())
        part = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        common = (most + 1) * n[most + 1] / n[1] if n[1] else 1.0
        worth[k] = {}
        for r in range(1, most + 1):
            turing = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
            better = r * (turing / r - common) / (1 - common) if common < 1 else 0.0
            worth[k][r] = better if 0 < better < r else r - part
    after = defaultdict(dict)
    for counts in grams.values():
        for g, c in counts.items():
            after[g[:-1]][g[-1]] = c

    @cache
    def weights(h):
        """What counts after ``h`` are divided by, and the weight of the order below."""
        k = len(h) + 1
        lost = sum(c - worth[k].get(c, c) for c in after[h].values())
        total = sum(after[h].values()) + (0 if lost > 0 else 1)
        rest = 1 - math.fsum(chance(h[1:], w) for w in after[h]) if h else 1
        return total, (lost if lost > 0 else 1) / total / rest

    @cache
    def chance(h, w):
        if h not in after:
            return chance(h[1:], w) if h else 1.0
        total, weight = weights(h)
        c = after[h].get(w, 0)
        if c:
            return worth[len(h) + 1].get(c, c) / total
        return weight * (chance(h[1:], w) if h else 1)

    words = [g[0] for g in grams[1]]
    for h in [h for h in list(after) if len(h) == order - 1][:20]:
        assert math.fsum(chance(h, w) for w in [*words, " never"]) == pytest.approx(1, abs=1e-9)
    return {d: sum(math.log10(chance(tuple(w[i - order + 1: i]), w[i])) for i in range(order - 1, len(w))) for d, w in tokens.items()}


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders(spark, docs, texts, order):  # noqa: F811
    got = by_id(katz_lm.katz_scores(docs, rule=katz_lm.KatzRule(order=order, group_tokens=300, shard_rows=100)), "score")
    assert {d: s for d, (s,) in got.items()} == pytest.approx(scores(texts, order), rel=1e-9)


def test_common_contexts_of_two_tokens(spark, docs, texts, monkeypatch):  # noqa: F811
    monkeypatch.setattr(katz_lm, "HOT_SHARE", 10**9)
    got = by_id(katz_lm.katz_scores(docs, rule=katz_lm.KatzRule(order=3, group_tokens=300, shard_rows=100)), "score")
    assert {d: s for d, (s,) in got.items()} == pytest.approx(scores(texts, 3), rel=1e-9)


def test_query_is_of_order_three(spark):
    got = by_id(queries.op10_katz_lm(spark, TABLES), "score")
    assert {d: s for d, (s,) in got.items()} == pytest.approx(scores(smallest_table(spark), 3), rel=1e-9)


def test_held_out_texts_alone(spark):
    held = [d for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1]
    frame = spark.createDataFrame([(d, "a b c") for d in held], "doc_id long, text string")
    assert {r.score for r in katz_lm.katz_scores(frame, rule=katz_lm.KatzRule(order=3)).collect()} == {0.0}
    assert katz_lm.katz_scores(frame.limit(0), rule=katz_lm.KatzRule(order=3)).count() == 0

"""Pivots of embedding near-dedup on tables whose sample has little to choose from."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402
from test_operators import by_id  # noqa: E402
from tugboard.llm import embedding_dedup  # noqa: E402


def agree(spark, vectors, rule):
    frame = spark.createDataFrame([(k, *v) for k, v in vectors.items()], "vec_id long, embedding array<double>, label int")
    got = by_id(embedding_dedup.near_copies(frame, rule=rule), "n_links", "component_id", "kept")
    assert got == plain.near_copies(vectors) and any(n for n, _, _ in got.values())


def test_sample_of_one_vector(spark):
    agree(spark, {k: ([1.0, 0.01 * (k % 7)], 0) for k in range(30)}, embedding_dedup.PivotRule(pivots=1))


def test_unusable_vectors_take_no_place_in_the_sample(spark):
    unusable = [[0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [-float("inf"), 1.0], []]
    agree(spark, {k: ([1.0, 0.01 * (k % 7)] if k % 50 == 0 else unusable[k % 5], 0) for k in range(1, 400)}, embedding_dedup.PivotRule(pivots=2))


def test_pivots_lie_on_both_sides():
    rows = np.array([[1.0, 0], [-1, 0], [1, 0], [0, 1], [-1, 0], [0, -1]])
    assert embedding_dedup.first_different(rows, 3).tolist() == [[1, 0], [-1, 0], [0, 1]]

"""Embeddings of several lengths in one table."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402
from test_operators import by_id  # noqa: E402
from tugboard.llm import embedding_dedup  # noqa: E402


def test_shorter_vectors_count_as_filled_up(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(4, 12))
    vectors = {}
    for k in range(80):
        v = base[k % 4] * (np.arange(12) < (12, 8, 5)[k % 3])
        vectors[k] = (v + rng.normal(size=12) * 0.01 * (k % 5 == 0) * (v != 0), k % 2)
    expected = plain.near_copies({k: (v.tolist(), label) for k, (v, label) in vectors.items()})
    # Each partition has one length, so no batch sees the greatest.
    rows = sorted(((k, v[:(12, 8, 5)[k % 3]].tolist(), label) for k, (v, label) in vectors.items()), key=lambda r: len(r[1]))
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, 9), "vec_id long, embedding array<double>, label int")
    rule = embedding_dedup.PivotRule(pivots=16, nearest=16, least_shared=1)
    assert by_id(embedding_dedup.near_copies(frame, rule=rule), "n_links", "component_id", "kept") == expected

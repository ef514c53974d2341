"""The manifest against a plain statement of the contract, over trees of one and of several rounds."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402
from tugboard.llm import merkle_manifest, queries, sha_states  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_states_are_those_of_sha256():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 256, (5, 9, 32), dtype=np.uint8)
    state = sha_states.start(9)
    for step in digests:
        state = sha_states.resume(state, sha_states.hex_blocks(step))
    found = [bytes(x) for x in sha_states.finish(state, np.full(9, 5))]
    assert found == [hashlib.sha256(b"".join(bytes(d[k]).hex().encode() for d in digests)).digest() for k in range(9)]
    assert bytes(sha_states.finish(sha_states.start(1), [0])[0]) == hashlib.sha256().digest()


def documents(n: int, seed: int):
    rng = random.Random(seed)
    langs = ["en"] * 8 + ["de", "fr", None, "", "é"] + [f"l{k}" for k in range(12)]
    return [
        (k, rng.choice([None, "", "Some Text", "ÄÖ and Z", "x" * 50]) if k % 7 else f"Row {k}", rng.choice(langs), rng.choice([None, "s", "S1"]), k if k % 5 else None)
        for k in rng.sample(range(10 * n), n)
    ]


def answers(spark, rows, levels, schema=DOCS):
    frame = spark.createDataFrame(rows, schema).repartition(3)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", queries.UPPER, queries.LOWER)).otherwise(F.col("text"))
    made = merkle_manifest.manifest(frame, "doc_id", "lang", queries.MANIFEST_FIELDS, {"text": tampered}, merkle_manifest.TreeRule(levels))
    return merkle_manifest.verified(made)


@pytest.mark.parametrize("levels", [1, 4])
@pytest.mark.parametrize("n", [9, 700])
def test_manifest(spark, n, levels):
    rows = documents(n, n)
    got = {r.doc_id: tuple(r)[1:] for r in answers(spark, rows, levels).collect()}
    assert got == plain.manifest(rows)


def test_one_group_of_one_run(spark):
    for n in (1, 8):
        rows = [(k, f"Text {k}", "en", "s", k) for k in range(n)]
        assert {r.doc_id: tuple(r)[1:] for r in answers(spark, rows, 4).collect()} == plain.manifest(rows)


def test_the_table(spark):
    found = queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*[c.split()[0] for c in DOCS.split(", ")]).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == plain.manifest([tuple(r) for r in rows])
    assert {r.verified for r in found} == {True, False}


def test_odd_rows(spark):
    clashing = ", tree string, place long, total long, block long, path string, row_id long, digest string, _read long"
    long = "A very long text. " * 200_000
    rows = [(None, "x", "en", None, 1), (None, "x", "en", None, 1), (3, None, None, None, None), (3, "", None, None, None), (5, long, "en", "s", 1), (5, long, "en", "s", 1)]
    found = answers(spark, [(*r, "t", 1, 2, 3, "p", 4, "d", 5) for r in rows], 1, DOCS + clashing).collect()
    assert len(found) == 6 and len({r.root for r in found}) == 1 and len({r.leaf for r in found}) == 4
    for r in found:   # nobody changes a row without a number, nor a null text, nor one without capitals
        assert r.verified == (r.doc_id != 5 or zlib.crc32(b"5") % 3 != 0)
    assert answers(spark, [], 4).count() == 0
    every = spark.createDataFrame([(1, 2)], "leaf long, root long")
    assert merkle_manifest.verified(merkle_manifest.manifest(every, "leaf", "root", ["leaf"]), "leaf").first()["_leaf"] == hashlib.sha256(b"1:1").hexdigest()

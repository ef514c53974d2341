"""The trie against a plain statement of the contract, whole and cut into very small shards."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402
from tugboard.llm import prefix_trie, queries  # noqa: E402

TABLE = "conv_id long, turn long, role string, text string"
RULES = [prefix_trie.TrieRule(), prefix_trie.TrieRule(3, 20, 60), prefix_trie.TrieRule(1, 1, 25), prefix_trie.TrieRule(7, 1000, 40, salts=2)]


def found(spark, rows, rule, schema=TABLE):
    paths = prefix_trie.paths_of(spark.createDataFrame(rows, schema).repartition(3))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    nodes = [tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.rebuilt(paths, head), rule).collect()]
    assert len(nodes) == len(set(nodes))
    return set(nodes)


def conversations(seed: int, n: int = 160):
    """Few different turns, so that beginnings branch everywhere; many copies, and some long ones."""
    rng = random.Random(seed)
    said = [("user", "hi"), ("user", "hi "), ("bot", "ä longer answer"), (None, "x"), ("", "x"), ("bot", None), ("bo", "tx")]
    rows, copied = [], [rng.choice(said) for _ in range(9)]
    for conv in rng.sample(range(400), n):
        kind = rng.random()
        turns = copied if kind < 0.4 else copied[:rng.randrange(9)] + [rng.choice(said) for _ in range(rng.randrange(1, 5))]
        turns = turns * 8 if kind > 0.97 else turns
        rows += [(conv, k if k else rng.choice([None, 0]), *turn) for k, turn in enumerate(turns)]
    return rows


@pytest.mark.parametrize("rule", RULES)
def test_trie(spark, rule):
    for seed in (1, 2):
        rows = conversations(seed)
        assert found(spark, rows, rule) == plain.trie(plain.rebuilt(rows))


def test_shards_of_any_size_give_the_same(spark):
    """Many random cuts of random tries, merged."""
    rng = random.Random(5)
    for _ in range(6):
        paths = {c: [("u", rng.choice("ab" * 3 + "cdefgh")) for _ in range(rng.choice([0, 1, 2, 3, 6, 12]))] for c in rng.sample(range(10**6), 120)}
        rows = [(c, None, [[f"{t[1]}".encode() * 16, 1] for t in path]) for c, path in paths.items()]
        frame = spark.createDataFrame([(c, p) for c, _, p in rows], "conv_id long, path array<struct<key: binary, size: long>>")
        rule = prefix_trie.TrieRule(rng.choice([1, 2, 5, 30]), 10**6, rng.choice([30, 100, 10**6]))
        assert {tuple(r) for r in prefix_trie.prefix_trie(frame, rule).collect()} == plain.trie(paths)


def test_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in queries.op12_conversation_trie(spark, "/root/testdata/sf0.001").collect()]
    assert set(got) == plain.trie(plain.rebuilt(rows)) and len(got) == len(set(got))


def test_odd_rows(spark):
    clashing = ", key long, path long, one long, family long, head long, node long, shard long"
    long = "A very long text. " * 200_000
    rows = [(None, 1, "a", "b"), (100, None, None, None), (100, None, "", ""), (101, 5, "u", long), (101, 5, "u", long), (102, 1, "u", "x"), (7, None, None, "y")]
    expected = plain.trie(plain.rebuilt(rows))
    for rule in RULES[:2]:
        assert found(spark, [(*r, *range(7)) for r in rows], rule, TABLE + clashing) == expected
    assert found(spark, [], RULES[0]) == set()
    assert found(spark, [(None, 1, "a", "b")], RULES[0]) == set()
    # A conversation shorter than its head, whose eldest is absent, has no turns left: the root alone.
    empty = next(c for c in range(201, 300) if plain.rebuilt([(c, 0, "u", "t")])[c] == [])
    assert found(spark, [(empty, 0, "u", "t")], RULES[0]) == {(empty, 0, None, 1, 0, 1, 0, plain.sha(str(empty).encode()))}

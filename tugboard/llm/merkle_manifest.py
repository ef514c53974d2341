"""A Merkle manifest of a dataset: leaves by row, a tree for each group, one tree over the groups.

A node of up to eight children is the SHA-256 of their hex digests. Every parent keeps the hash state it
had before each child slot, so a path is checked from below by *resuming*: the state before the slot, the
replaced child, the siblings to its right, end. What stands left of the slot is never hashed again.

The leaves are put in order by a range shuffle of their digests alone (texts do not move) and numbered
from one small table of counts per range. 8^4 leaves make a subtree, which one task folds in memory;
its root is one leaf of the next round. Rounds end where each tree has one block: with 4096 leaves in a
block, four rounds hold 10^14 rows. Going down, a block gets the path of its own root and hands longer ones to
its nodes. A group that holds most rows is many blocks like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tugboard.llm import sha_states
from tugboard.llm.shared import fresh, stored

ARITY = 8
BROADCAST_ROWS = 200_000   # more ranges and groups than this are joined by a shuffle
DIGEST = 32


@dataclass(frozen=True)
class TreeRule:
    levels: int = 4   # levels of parents that one task folds at a time

    @property
    def block(self) -> int:
        return ARITY**self.levels

    def levels_of(self, nodes: int, total: int) -> int:
        """How many levels of parents stand on a block's nodes: all of its tree's, or ``levels`` where blocks go on above."""
        if total > self.block:
            return self.levels
        levels = 0
        while nodes > 1:
            nodes, levels = -(-nodes // ARITY), levels + 1
        return levels


def row_digest(fields: list[Column]) -> Column:
    """SHA-256 in hex over all fields: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    def part(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(field) for field in fields]).cast("binary"), 256)


def _joined(left: DataFrame, right: DataFrame, *keys: str, small: bool = False) -> DataFrame:
    """Inner join on ``tree``, where null is a value like any other, and ``keys``; the other names must differ."""
    both = ["tree", *keys]
    named = right.select(*[F.col(k).alias(f"_of_{k}") for k in both], *[c for c in right.columns if c not in both])
    met = F.col("tree").eqNullSafe(F.col("_of_tree"))
    for key in keys:
        met = met & (F.col(key) == F.col(f"_of_{key}"))
    return left.join(F.broadcast(named) if small else named, met).drop(*[f"_of_{k}" for k in both])


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, the number of each within its ``tree`` in ``order`` (nulls first), and ``total``.

    Only a table with one row per range and tree is looked at for the numbers. Equal rows are told apart by
    where they were read, so that a third of all rows may be equal and still fall into many ranges.
    """
    by = [F.col(name).asc_nulls_first() for name in ("tree", *order, "_read")]
    ranged = stored(
        rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_read")
        .withColumn("_row", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_row", 33))
    )
    counts = ranged.groupBy("tree", "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("tree").orderBy("_range")
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy("tree")
    starts = stored(counts.select("tree", "_range", "_first", before.alias("_before"), F.sum("_n").over(whole).alias("total")))
    found = _joined(ranged, starts, "_range", small=starts.count() <= BROADCAST_ROWS)
    return found.select(*rows.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias("place"), "total")


def _fold_block(leaves: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests of each level, the root's last, and per level below it the parents' states before each node."""
    digests, states = [leaves], []
    for _ in range(levels):
        children = digests[-1]
        n = len(children)
        parents = -(-n // ARITY)
        state, before = sha_states.start(parents), np.empty((n, 8), np.uint32)
        words = sha_states.hex_blocks(children)
        for slot in range(min(ARITY, n)):
            here = np.arange(slot, n, ARITY)   # all parents, or all but the last
            k = len(here)
            before[here] = state[:, :k].T
            state[:, :k] = sha_states.resume(state[:, :k], words[:, here])
        sizes = np.full(parents, ARITY)
        sizes[-1] = n - ARITY * (parents - 1)
        digests.append(sha_states.finish(state, sizes))
        states.append(before)
    return digests, states


def _blocks(nodes: DataFrame, carried: dict[str, str], rule: TreeRule) -> DataFrame:
    """Nodes with ``tree, place, total, digest`` folded into one row per block; ``carried`` columns become arrays."""
    kinds = "".join(f", {name} array<{kind}>" for name, kind in carried.items())
    tree = nodes.schema["tree"].dataType.simpleString()
    names = list(carried)

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        leaves = np.frombuffer(b"".join(group["digest"].to_pylist()), np.uint8).reshape(-1, DIGEST)
        total = group["total"][0].as_py()
        digests, states = _fold_block(leaves, rule.levels_of(len(leaves), total))
        made = {
            "tree": group["tree"].slice(0, 1),
            "block": pa.array([group["place"][0].as_py() // rule.block], pa.int64()),
            "total": pa.array([total], pa.int64()),
            "root": pa.array([digests[-1].tobytes()], pa.binary()),
            "digests": pa.array([b"".join(x.tobytes() for x in digests)], pa.binary()),
            "states": pa.array([b"".join(x.tobytes() for x in states)], pa.binary()),
        }
        for name in names:
            values = pa.concat_arrays(group[name].chunks)
            made[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.table(made)

    keyed = nodes.withColumn("block", F.expr(f"place div {rule.block}"))
    schema = f"tree {tree}, block bigint, total bigint, root binary, digests binary, states binary{kinds}"
    return keyed.groupBy("tree", "block").applyInArrow(pack, schema)


@dataclass(frozen=True)
class Forest:
    rounds: list[DataFrame]   # blocks: tree, block, total, root, digests, states and what the leaves carry
    rule: TreeRule

    def roots(self) -> DataFrame:
        """``tree, root``, one row for each tree."""
        found = [blocks.where(F.col("total") <= self.rule.block).select("tree", "root") for blocks in self.rounds]
        return reduce(DataFrame.unionByName, found)


def grown(nodes: DataFrame, carried: dict[str, str], rule: TreeRule) -> Forest:
    """All rounds of blocks over placed ``nodes``. The driver learns one number a round, the largest tree's size."""
    rounds = [stored(_blocks(nodes, carried, rule))]
    while (rounds[-1].agg(F.max("total")).first()[0] or 0) > rule.block:
        above = rounds[-1].where(F.col("total") > rule.block).select(
            "tree", F.col("block").alias("place"), F.expr(f"(total + {rule.block - 1}) div {rule.block}").alias("total"),
            F.col("root").alias("digest"),
        )
        rounds.append(stored(_blocks(above, {}, rule)))
    return Forest(rounds, rule)


@dataclass(frozen=True)
class _Step:
    """One level of a path: the parent's state before the slot, and the slot's siblings on either side."""

    state: bytes
    left: bytes
    right: bytes

    def packed(self) -> bytes:
        return bytes([len(self.left) // DIGEST, len(self.right) // DIGEST]) + self.state + self.left + self.right


def _steps(path: bytes) -> list[_Step]:
    found, at = [], 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        state, middle = at + 2 + DIGEST, at + 2 + DIGEST * (1 + left)
        end = middle + DIGEST * right
        found.append(_Step(path[at + 2: state], path[state: middle], path[middle: end]))
        at = end
    return found


class _Block:
    """A stored block, opened again."""

    def __init__(self, n: int, levels: int, digests: bytes, states: bytes):
        every, kept = np.frombuffer(digests, np.uint8).reshape(-1, DIGEST), np.frombuffer(states, np.uint32).reshape(-1, 8)
        self.n, self.leaves = n, every[:n]
        self.digests, self.states, at = [], [], 0
        for _ in range(levels):
            self.digests.append(every[at: at + n])
            self.states.append(kept[at: at + n])
            at, n = at + n, -(-n // ARITY)

    def path(self, place: int) -> bytes:
        steps = []
        for digests, states in zip(self.digests, self.states):
            first = place // ARITY * ARITY
            run = digests[first: first + ARITY]
            slot = place - first
            steps.append(_Step(states[place].tobytes(), run[:slot].tobytes(), run[slot + 1:].tobytes()).packed())
            place //= ARITY
        return b"".join(steps)

    def siblings_hex(self) -> list[bytes]:
        """Per node: the hex texts of its siblings, level by level up to the block's root, left to right."""
        texts = [sha_states.hex_text(d).tobytes() for d in self.digests]
        runs = 64 * ARITY
        inner = [b""]   # of the level above, by node
        for text in reversed(texts):
            found = []
            for at in range(0, len(text), 64):
                first = at // runs * runs
                found.append(text[first: at] + text[at + 64: first + runs] + inner[at // runs])
            inner = found
        return inner

    def fold(self, digests: np.ndarray, above: list[_Step]) -> np.ndarray:
        """The root that follows if each node's digest is replaced, each on its own: its parent's kept state, the
        replacement, the right siblings, and so on upwards."""
        place = np.arange(len(digests))
        for level, states in zip(self.digests, self.states):
            n = len(level)
            words = sha_states.hex_blocks(level)
            state = sha_states.resume(np.ascontiguousarray(states[place].T), sha_states.hex_blocks(digests))
            slot = place % ARITY
            size = np.minimum(ARITY, n - (place - slot))
            for step in range(1, ARITY):
                going = np.flatnonzero(slot + step < size)
                if len(going):
                    state[:, going] = sha_states.resume(state[:, going], words[:, place[going] + step])
            digests, place = sha_states.finish(state, size), place // ARITY
        for step in above:
            state = np.repeat(np.frombuffer(step.state, np.uint32)[:, None], len(digests), axis=1)
            state = sha_states.resume(state, sha_states.hex_blocks(digests))
            right = np.frombuffer(step.right, np.uint8).reshape(-1, DIGEST)
            for sibling in sha_states.hex_blocks(right).T if len(right) else ():
                state = sha_states.resume(state, sibling[:, None])
            size = (len(step.left) + len(step.right)) // DIGEST + 1
            digests = sha_states.finish(state, np.full(len(digests), size))
        return digests


def _opened(batch: pa.RecordBatch, k: int, rule: TreeRule) -> _Block:
    total, number, digests, states = (batch[c][k].as_py() for c in ("total", "block", "digests", "states"))
    n = min(rule.block, total - number * rule.block)
    return _Block(n, rule.levels_of(n, total), digests, states)


def with_paths(forest: Forest, root_paths: DataFrame) -> DataFrame:
    """The lowest round's blocks with ``path, subroot``: their roots' way up to the root above all, and their tree's root.

    ``root_paths`` holds ``tree, path, subroot``. Every join is by tree and block, of which there is one each.
    """
    rule, handed, lower = forest.rule, None, None
    tree = root_paths.schema["tree"].dataType.simpleString()

    def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, path, number = _opened(batch, k, rule), batch["path"][k].as_py(), batch["block"][k].as_py()
                n, again = block.n, pa.array([k] * block.n)
                numbers = pa.array(np.arange(n) + number * rule.block)
                paths = pa.array([block.path(place) + path for place in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch["tree"].take(again), numbers, paths, batch["subroot"].take(again)], ["tree", "block", "path", "subroot"]
                )

    for number, blocks in reversed(list(enumerate(forest.rounds))):
        tops = blocks.where(F.col("total") <= rule.block).select("tree", "block")
        paths = _joined(tops, root_paths)
        paths = paths if handed is None else paths.unionByName(handed)
        lower = _joined(blocks, paths, "block")
        if number:
            handed = stored(lower.mapInArrow(hand_down, f"tree {tree}, block bigint, path binary, subroot binary"))
    return lower


@dataclass(frozen=True)
class Manifest:
    groups: Forest     # a tree for each group, over the rows' leaves
    dataset: Forest    # one tree, over the groups' roots

    def root(self) -> bytes:
        """The dataset's digest; empty for a table without rows."""
        found = self.dataset.roots().first()
        return bytes(found.root) if found else b""

    def root_paths(self) -> DataFrame:
        """``tree, path, subroot``: each group's root and its way to the dataset's."""
        rule, spark = self.dataset.rule, self.dataset.rounds[0].sparkSession
        above = spark.createDataFrame([("", b"", b"")], "tree string, path binary, subroot binary")
        kind = self.groups.rounds[0].schema["tree"].dataType.simpleString()

        def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    block, path = _opened(batch, k, rule), batch["path"][k].as_py()
                    ways = [block.path(place) + path for place in range(block.n)]
                    own = [x.tobytes() for x in block.leaves]
                    yield pa.RecordBatch.from_arrays(
                        [batch["members"][k].values, pa.array(ways, pa.binary()), pa.array(own, pa.binary())], ["tree", "path", "subroot"]
                    )

        return stored(with_paths(self.dataset, above).select("block", "total", "digests", "states", "path", "members").mapInArrow(
            paths, f"tree {kind}, path binary, subroot binary"
        ))


def manifest(rows: DataFrame, id: str, group: str, fields: list[str], presented: dict[str, Column] | None = None,
             rule: TreeRule = TreeRule()) -> Manifest:
    """The manifest of ``rows``: leaves over ``fields``, in the order of ``id`` within each ``group``.

    ``presented`` names fields that a checker reads differently now; the leaf they give travels beside the true one.
    Null ids and the null group come first, rows of one id are ordered by their leaves, rows that repeat are
    leaves of their own, null fields and empty ones give different leaves, texts of any length are one hash, and a
    table without rows has trees without blocks. Other columns are not looked at.
    """
    shown = presented or {}
    leaf = F.unhex(row_digest([F.col(f) for f in fields]))
    base = rows.select(
        F.col(group).alias("tree"), F.col(id).alias("row_id"), leaf.alias("digest"),
        (F.unhex(row_digest([shown.get(f, F.col(f)) for f in fields])) if shown else leaf).alias("presented"),
    )
    kinds = dict(base.dtypes)
    groups = grown(placed(base, ["row_id", "digest"]), {"row_id": kinds["row_id"], "presented": "binary"}, rule)
    named = groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("members"), F.col("root").alias("digest"))
    return Manifest(groups, grown(placed(named, ["members"]), {"members": kinds["tree"]}, rule))


def verified(made: Manifest, id: str = "doc_id") -> DataFrame:
    """Per row: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``folded_root`` resumes the parents' kept states with the presented leaf; ``proof_sha256`` is the SHA-256 of all
    siblings' hex digests on the way up. Where ``id`` has the name of another result, that one gets underscores.
    """
    rule, root = made.groups.rule, made.root().hex()
    known = with_paths(made.groups, made.root_paths())
    id_kind = known.schema["row_id"].dataType.elementType.simpleString()
    named = [id, *fresh([id], "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, above = _opened(batch, k, rule), _steps(batch["path"][k].as_py())
                presented = np.frombuffer(b"".join(batch["presented"][k].values.to_pylist()), np.uint8).reshape(-1, DIGEST)
                ending = b"".join((step.left + step.right).hex().encode() for step in above)
                folded = [x.tobytes().decode() for x in sha_states.hex_text(block.fold(presented, above))]
                yield pa.RecordBatch.from_arrays([
                    batch["row_id"][k].values,
                    pa.array([x.tobytes().decode() for x in sha_states.hex_text(block.leaves)]),
                    pa.array([batch["subroot"][k].as_py().hex()] * block.n),
                    pa.array([root] * block.n),
                    pa.array([hashlib.sha256(own + ending).hexdigest() for own in block.siblings_hex()]),
                    pa.array(folded),
                    pa.array([x == root for x in folded]),
                ], named)

    texts = ", ".join(f"`{name}` string" for name in named[1:-1])
    return known.mapInArrow(rows, f"`{named[0]}` {id_kind}, {texts}, `{named[-1]}` boolean")

"""A trie of conversations' common beginnings, by vertical bitmaps.

Conversations are put in order of their turns by a range shuffle of turn digests (texts do not move), so a
task streams through neighbours and cuts them into *shards* of bounded size. A shard indexes (position,
turn) to the bitset of its conversations and goes through its part of the trie depth first: a node's
bitset, cut with the posting of the next turn of its lowest conversation, is a child; popcounts, lowest
bits and the bitset of ended conversations give the node's row.

Nodes whose conversations include a shard's first or last one may go on in the shards next to it; all
others are whole and final. Only those two paths of each shard are merged: counts add up, and what a subtree holds
that lies in several shards, so was counted several times, is corrected along the path of the first
shard that has it. A beginning that a third of all conversations share therefore costs one row for each of its
shards, and the root is never a key that rows meet at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tugboard.llm.shared import stored

KEY = 16
NO_ENDS = hashlib.sha256().hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@dataclass(frozen=True)
class TrieRule:
    shard_conversations: int = 4096   # bits of a shard's bitsets
    shard_turns: int = 65_536         # a shard also ends where it holds so many turns
    partition_turns: int = 1_000_000  # turns aimed at per task
    salts: int = 16                   # tasks that the shards' rows of one shared node are dealt to


def turn_digest(role: str, text: str) -> Column:
    """16 bytes that stand for a turn; null role or text counts as empty."""
    first, second = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    whole = F.concat(F.octet_length(first).cast("string"), F.lit(":"), first, second)
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * KEY))


def paths_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, path``: each conversation's turns as (key, size) in order, sizes in code points.

    Null turn numbers come first, equal ones are in the order of their turns' digests. Rows without a
    conversation belong to none and are left out.
    """
    size = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    turns = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), turn_digest(role, text).alias("key"), size.alias("size")).alias("one"),
    )
    ordered = F.sort_array(F.collect_list("one"))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"))).alias("path"))


def _bits(numbers: list[int], size: int) -> int:
    if len(numbers) == 1:
        return 1 << numbers[0]
    held = bytearray(size // 8 + 1)
    for n in numbers:
        held[n >> 3] |= 1 << (n & 7)
    return int.from_bytes(held, "little")


def _members(bits: int) -> list[int]:
    found, text = [], bits.to_bytes((bits.bit_length() + 7) // 8, "little")
    for at, byte in enumerate(text):
        while byte:
            low = byte & -byte
            found.append(at * 8 + low.bit_length() - 1)
            byte ^= low
    return found


def _prefix_keys(keys: list[bytes]) -> list[bytes]:
    """A digest of every beginning of a path, the empty one first."""
    state = hashlib.sha256()
    found = [state.digest()[:KEY]]
    for key in keys:
        state.update(key)
        found.append(state.digest()[:KEY])
    return found


class Shard:
    """Neighbouring conversations in path order; bit numbers follow the conversation ids."""

    def __init__(self, number: int, rows: list[tuple[int, list[bytes], list[int]]]):
        self.number = number
        self.first, self.last = rows[0][0], rows[-1][0]
        rows = sorted(rows, key=lambda row: row[0])
        self.ids, self.keys, self.sizes = ([row[k] for row in rows] for k in range(3))
        postings: dict[tuple[int, bytes], list[int]] = {}
        lengths: dict[int, list[int]] = {}
        for bit, keys in enumerate(self.keys):
            lengths.setdefault(len(keys), []).append(bit)
            for position, key in enumerate(keys):
                postings.setdefault((position, key), []).append(bit)
        n = len(rows)
        self.postings = {at: _bits(bits, n) for at, bits in postings.items()}
        self.lengths = {length: _bits(bits, n) for length, bits in lengths.items()}

    def nodes(self) -> Iterator[dict]:
        """Every node, children before parents, with what its subtree holds in this shard."""
        edges = [(self.ids.index(c), _prefix_keys(self.keys[self.ids.index(c)])) for c in (self.first, self.last)]
        totals = [[0, 0, 0]]           # per open depth: childless nodes, sizes of nodes, sizes times members
        stack = [(0, (1 << len(self.ids)) - 1, False, 0, None)]   # depth, members, gone through, children, parent's place
        inner = [0]                    # per open depth: children that touch neither edge
        while stack:
            depth, members, through, children, parent = stack.pop()
            low = (members & -members).bit_length() - 1
            if not through:
                ended = members & self.lengths.get(depth, 0)
                rest, found = members & ~ended, []
                while rest:
                    lowest = (rest & -rest).bit_length() - 1
                    child = rest & self.postings[depth, self.keys[lowest][depth]]
                    found.append(child)
                    rest &= ~child
                stack.append((depth, members, True, len(found), parent))
                sides = [side for side in (0, 1) if members >> edges[side][0] & 1]
                where = (sides[0], depth) if sides else None
                stack.extend((depth + 1, child, False, 0, where or low) for child in reversed(found))
                while len(totals) <= depth + 1:
                    totals.append([0, 0, 0])
                    inner.append(0)
                totals[depth + 1], inner[depth + 1] = [0, 0, 0], 0
                continue
            n, size = members.bit_count(), self.sizes[low][depth - 1] if depth else 0
            below = totals[depth + 1]
            held = [below[0] + (children == 0), below[1] + size, below[2] + n * size]
            totals[depth + 1] = [0, 0, 0]
            above = totals[depth]
            for k in range(3):
                above[k] += held[k]
            sides = [side for side in (0, 1) if members >> edges[side][0] & 1]
            ended = [self.ids[bit] for bit in _members(members & self.lengths.get(depth, 0))]
            listed = ",".join(map(str, ended))
            row = {
                "shard": self.number, "depth": depth, "conv_id": self.ids[low], "n_convs": n, "size": size,
                "leaves": held[0], "sizes": held[1], "weighted": held[2], "inner_children": inner[depth + 1], "childless": int(children == 0),
            }
            inner[depth + 1] = 0
            if not sides:
                inner[depth] += 1
                at_edge = isinstance(parent, tuple)
                yield row | {
                    "side": None, "key": None, "counts": None, "ends": None,
                    "inner_children": children, "parent_side": parent[0] if at_edge else None,
                    "parent_conv_id": None if at_edge else self.ids[parent],
                    "ends_sha256": hashlib.sha256(listed.encode()).hexdigest(),
                }
            for side in sides:
                yield row | {
                    "side": side, "key": edges[side][1][depth], "counts": side == sides[0], "ends": listed if side == sides[0] and ended else None,
                    "parent_side": None, "parent_conv_id": None, "ends_sha256": None,
                }


PIECE = {
    "shard": "bigint", "side": "int", "depth": "bigint", "key": "binary", "counts": "boolean", "conv_id": "bigint", "parent_side": "int",
    "parent_conv_id": "bigint", "n_convs": "bigint", "size": "bigint", "inner_children": "bigint", "childless": "bigint", "leaves": "bigint",
    "sizes": "bigint", "weighted": "bigint", "ends": "string", "ends_sha256": "string",
}
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
_ROWS = 10_000


def _pieces(rule: TrieRule):
    def batches_of(nodes: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        held = []
        for node in nodes:
            held.append(node)
            if len(held) == _ROWS:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[c] for node in held], _ARROW[kind]) for c, kind in PIECE.items()], list(PIECE))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        task, number, rows, turns = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for conv, keys, sizes in zip(*(batch[c].to_pylist() for c in ("conv_id", "keys", "sizes"))):
                if rows and (len(rows) == rule.shard_conversations or turns + len(keys) > rule.shard_turns):
                    yield Shard((task << 32) + number, rows)
                    number, rows, turns = number + 1, [], 0
                rows.append((conv, keys, sizes))
                turns += len(keys)
        if rows:
            yield Shard((task << 32) + number, rows)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            yield from batches_of(shard.nodes())

    return pieces


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per key, whose rows come one after another in the order of shards: the SHA-256 of all lists in a row."""
    current, state = None, None

    def closed() -> Iterator[pa.RecordBatch]:
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    for batch in batches:
        for key, ends in zip(batch["key"].to_pylist(), batch["ends"].to_pylist()):
            if key != current:
                yield from closed()
                current, state = key, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
    yield from closed()


def _shared_nodes(edges: DataFrame, rule: TrieRule) -> tuple[DataFrame, DataFrame]:
    """The nodes on shards' first and last paths, once each and whole; and per (shard, side, depth) their ``conv_id``."""
    counted = edges.where("counts")
    merged = counted.groupBy("key").agg(
        F.min("conv_id").alias("node"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.max("size").alias("size"),
        F.sum("inner_children").alias("inner_children"), F.sum("leaves").alias("leaves"), F.sum("sizes").alias("sizes"),
        F.sum("weighted").alias("weighted"), F.sum("childless").alias("childless"), F.count(F.lit(1)).alias("shards"), F.min("shard").alias("owner"),
    )
    salt = F.pmod(F.xxhash64("shard"), F.lit(rule.salts)).cast("int")
    facts = merged.select(
        F.col("key").alias("_key"), "node", "owner", "shards", "childless", F.col("size").alias("_size"),
        F.explode(F.sequence(F.lit(0), F.lit(rule.salts - 1))).alias("_salt"),
    )
    known = stored(
        edges.select("shard", "side", "depth", "key", salt.alias("salt"))
        .join(facts, (F.col("key") == F.col("_key")) & (F.col("salt") == F.col("_salt")))
        .select("shard", "side", "depth", "key", "node", "owner", "shards", "childless", F.col("_size").alias("size"))
    )
    # Along a path of a shard: the node above, and what its part of the trie counted too often, from below.
    along = Window.partitionBy("shard", "side").orderBy("depth")
    below = Window.partitionBy("shard", "side").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    mine = (F.col("owner") == F.col("shard")) & (F.col("side") == 1) & (F.col("shards") > 1)
    # A node in several shards is childless if it is in all of them.
    truly = (F.col("childless") == F.col("shards")).cast("long") - F.col("childless")
    told = known.select(
        "shard", "side", "depth", "key", "node", F.lag("node").over(along).alias("parent_conv_id"), F.lag("key").over(along).alias("parent_key"),
        F.sum(F.when(mine, truly).otherwise(0)).over(below).alias("more_leaves"),
        F.sum(F.when(mine, (1 - F.col("shards")) * F.col("size")).otherwise(0)).over(below).alias("more_sizes"),
    )
    told = stored(told)
    corrected = told.groupBy("key").agg(
        F.sum("more_leaves").alias("more_leaves"), F.sum("more_sizes").alias("more_sizes"),
        F.min("parent_conv_id").alias("parent_conv_id"), F.min("parent_key").alias("parent_key"),
    )
    children = corrected.groupBy(F.col("parent_key").alias("of")).agg(F.count(F.lit(1)).alias("edge_children"))
    listed = edges.where(F.col("ends").isNotNull()).select("key", "shard", "ends")
    ends = listed.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_hashed_ends, "key binary, ends_sha256 string")
    whole = merged.join(corrected, "key").join(ends, "key", "left").join(children, F.col("key") == F.col("of"), "left")
    nodes = whole.select(
        F.col("node").alias("conv_id"), "depth", "parent_conv_id", "n_convs",
        (F.col("inner_children") + F.coalesce("edge_children", F.lit(0))).alias("n_children"),
        (F.col("leaves") + F.col("more_leaves")).alias("n_leaves"),
        (F.col("weighted") - F.col("sizes") - F.col("more_sizes")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return nodes, told.select("shard", "side", "depth", "node")


def prefix_trie(paths: DataFrame, rule: TrieRule = TrieRule()) -> DataFrame:
    """One row per distinct beginning of ``paths`` (``conv_id, path`` of (key, size)), columns ``NODE``.

    A conversation without turns is a member of the root; a table without conversations has no root. Ids must be
    unique; equal paths of different ids share all their nodes. A conversation is held by one task, 24 bytes a turn.
    """
    keyed = stored(paths.select("conv_id", F.col("path.key").alias("keys"), F.col("path.size").alias("sizes")))
    turns = keyed.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    parts = max(1, -(-turns // rule.partition_turns), min(keyed.sparkSession.sparkContext.defaultParallelism, turns // rule.shard_turns))
    in_order = keyed.repartitionByRange(int(parts), "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    pieces = stored(in_order.mapInArrow(_pieces(rule), ", ".join(f"{c} {kind}" for c, kind in PIECE.items())))
    whole = pieces.where(F.col("side").isNull()).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("inner_children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("weighted") - F.col("sizes")).alias("saved_tokens"), "ends_sha256", "shard", "parent_side",
    )
    shared, parents = _shared_nodes(pieces.where(F.col("side").isNotNull()), rule)
    above = parents.select(F.col("shard").alias("_shard"), F.col("side").alias("_side"), (F.col("depth") + 1).alias("_depth"), "node")
    met = (F.col("shard") == F.col("_shard")) & (F.col("parent_side") == F.col("_side")) & (F.col("depth") == F.col("_depth"))
    below_edge = whole.where(F.col("parent_side").isNotNull()).join(above, met).withColumn("parent_conv_id", F.col("node"))
    return whole.where(F.col("parent_side").isNull()).select(NODE).unionByName(below_edge.select(NODE)).unionByName(shared.select(NODE))


def rebuilt(paths: DataFrame, head: Column, family: int = 100, longest_head: int = 5) -> DataFrame:
    """Each conversation as the first ``head`` turns of its family's eldest, then its own turns after as many.

    ``conv_id`` c belongs to c - c % family, which may be absent and then gives no turns; at most ``longest_head``
    turns are taken. A family is at most ``2 * family`` conversations, which meet in one task.
    """
    eldest = F.col("conv_id") - F.col("conv_id") % family
    mine = paths.withColumns({"family": eldest, "head": head})
    beginning = F.when(F.col("conv_id") == F.col("family"), F.slice("path", 1, longest_head))
    told = mine.withColumn("theirs", F.first(beginning, ignorenulls=True).over(Window.partitionBy("family")))
    theirs = F.coalesce(F.slice("theirs", 1, F.col("head")), F.slice("path", 1, 0))
    own = F.slice("path", F.col("head") + 1, F.greatest(F.size("path"), F.lit(1)))
    return told.select("conv_id", F.concat(theirs, own).alias("path"))

"""Drops lines that an earlier document has, by probing arrays behind a sharded minimal perfect hash.

1. Every document gives the 128-bit hashes of its distinct long lines (``line_keys``).
2. They are counted, with the smallest document that holds each (a hash aggregate, combined per task).
   The distinct ones are dealt to shards by hash, and each shard is built into a minimal perfect hash,
   which indexes three flat arrays: a 32-bit fingerprint, the count and the owner (``build_shards``).
3. The documents' hashes go to the shards, where a shard's arrays come first and the hashes stream past
   them in batches (``probe``). No line is joined or sorted against others.
4. What must go returns to its document, and the text is put together again.

A line that very many documents share would send its hashes to one shard. The few lines that make up
over 1/``hot_share`` of all hashes, at most ``hot_share`` of them, are therefore looked up in the tasks
that read the hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tugboard.llm.perfect_hash import PerfectHash
from tugboard.llm.shared import bounded_batches, fresh, stored, texts, widened

STRIPPED = b" \t\n\x0b\x0c\r"
ARRAYS = "shard int, first int, id bigint, high bigint, low bigint, sizes array<bigint>, bits binary, prints binary, counts binary, owners binary"


@dataclass(frozen=True)
class LineRule:
    min_chars: int = 10
    shard_lines: int = 100_000   # distinct lines aimed at per shard
    hot_share: int = 2000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte key of a line, or None for one that is too short to be dropped."""
    stripped = line.strip(STRIPPED)
    if len(stripped) < min_chars or len(stripped) < 4 * min_chars and len(stripped.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(stripped.lower())


def line_keys(docs: DataFrame, id: str, text: str, rule: LineRule) -> DataFrame:
    """``id, high, low`` for each distinct long line of each row with an id."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, body in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                own = {key for line in body.split(b"\n") if (key := line_key(line, rule.min_chars))}
                found += own
                ids += [doc] * len(own)
            halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["id", "high", "low"]
            )

    taken = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return taken.where("id is not null").mapInArrow(keys, "id bigint, high bigint, low bigint")


def build_shards(lines: DataFrame, shards: int) -> DataFrame:
    """One row of arrays per shard of ``high, low, count, owner``."""
    def build(key: tuple, table: pa.Table) -> pa.Table:
        high, low, count, owner = (table.column(c).to_numpy() for c in ("high", "low", "count", "owner"))
        index = PerfectHash.build(high.view(np.uint64), low.view(np.uint64))
        place = index.index(high.view(np.uint64), low.view(np.uint64))
        prints, counts, owners = np.empty(len(high), np.uint32), np.empty(len(high), np.int64), np.empty(len(high), np.int64)
        prints[place], counts[place], owners[place] = low.astype(np.uint32), count, owner
        sizes, bits = index.packed()
        row = [key[0].as_py(), 0, None, None, None, sizes, bits, prints.tobytes(), counts.tobytes(), owners.tobytes()]
        names = [field.split()[0] for field in ARRAYS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return lines.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, ARRAYS)


def _shard(shards: int):
    return F.pmod(F.xxhash64("high", "low"), F.lit(shards)).cast("int")


def probe(keys: DataFrame, arrays: DataFrame, shards: int) -> DataFrame:
    """``id, high, low`` of the keys that a smaller id owns. A shard's arrays come first, its keys stream behind."""
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = -1, None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            firsts = batch.column("first").to_numpy()
            cuts = np.flatnonzero((np.diff(numbers, prepend=-1) != 0) | (firsts == 0))
            for begin, end in zip(cuts, [*cuts[1:], len(numbers)], strict=True):
                part = batch.slice(begin, end - begin)
                if firsts[begin] == 0:
                    row = part.slice(0, 1).to_pylist()[0]
                    shard, index = row["shard"], PerfectHash.unpacked(row["sizes"], row["bits"])
                    prints = np.frombuffer(row["prints"], np.uint32)
                    counts, owners = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["owners"], np.int64)
                    part = part.slice(1)
                if not len(part) or numbers[begin] != shard:
                    continue
                high, low = part.column("high").to_numpy(), part.column("low").to_numpy()
                place = index.index(high.view(np.uint64), low.view(np.uint64))
                known = (place >= 0) & (prints[place] == low.astype(np.uint32)) & (counts[place] > 1)
                gone = known & (owners[place] < part.column("id").to_numpy())
                yield part.select(["id", "high", "low"]).filter(pa.array(gone))

    empty = {"sizes": "array<bigint>", **dict.fromkeys(("bits", "prints", "counts", "owners"), "binary")}
    asked = keys.select(
        _shard(shards).alias("shard"), F.lit(1).alias("first"), "id", "high", "low",
        *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()],
    )
    dealt = arrays.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "first")
    return dealt.mapInArrow(look_up, "id bigint, high bigint, low bigint")


def repeated_lines(docs: DataFrame, id: str, text: str, rule: LineRule) -> DataFrame:
    """``id, gone``: the 16-byte keys of the lines that each document loses, one row per document that loses any."""
    spark = docs.sparkSession
    keys = stored(line_keys(docs, id, text, rule))
    counted = stored(keys.groupBy("high", "low").agg(F.count(F.lit(1)).alias("count"), F.min("id").alias("owner")))
    lines, total = counted.agg(F.count(F.lit(1)), F.sum("count")).first()
    shards = max(1, -(-lines // rule.shard_lines))
    limit = (total or 0) // rule.hot_share
    # At most hot_share lines can have more than total / hot_share hashes.
    hot = {(r.high, r.low): r.owner for r in counted.where((F.col("count") > limit) & (F.col("count") > 1000)).collect()}
    hot_lines = np.array(sorted(hot), np.int64).reshape(-1, 2)
    owners = np.array([hot[tuple(x)] for x in hot_lines.tolist()], np.int64)

    def hot_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {bytes(k): n for n, k in enumerate(hot_lines)}
        for batch in batches:
            pairs = np.stack([batch.column("high").to_numpy(), batch.column("low").to_numpy()], axis=1)
            which = np.array([numbers.get(bytes(k), -1) for k in pairs], np.int64)
            own = np.append(owners, np.iinfo(np.int64).max)[which]
            yield batch.filter(pa.array(own < batch.column("id").to_numpy()))

    highs = [int(x) for x in {k[0] for k in hot}]
    is_hot = F.col("high").isin(highs) if highs else F.lit(False)
    gone = probe(keys.where(~is_hot), build_shards(counted.where(~is_hot), shards), shards)
    if hot:
        gone = gone.unionByName(keys.where(is_hot).mapInArrow(hot_ones, "id bigint, high bigint, low bigint"))
    return gone.distinct().groupBy("id").agg(F.collect_list(F.struct("high", "low")).alias("gone"))


def drop_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: LineRule = LineRule(),
                        counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the lines left out that a document of a smaller id holds, and two counts per row.

    Lines are compared without the white space around them and with A-Z in lower case; those of fewer
    than ``min_chars`` code points always stay. Line order is kept. A null or empty text is one empty
    line. Rows without an id neither own lines nor lose any. Rows that share an id count as one
    document. Other columns stay as they are; the two counts must not clash with them.
    """
    bounded_batches(docs.sparkSession)
    owner, gone = fresh([*docs.columns, *counts], "owner", "gone")
    dropped = repeated_lines(docs, id, text, rule).select(F.col("id").alias(owner), F.col("gone").alias(gone))
    joined = docs.join(dropped, docs[id].cast("bigint") == F.col(owner), "left").drop(owner)
    at = docs.columns.index(text)
    keep = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, lines, lost = texts(batch.column(at)), [], []
            for k, keys in enumerate(batch.column(gone).to_pylist()):
                parts = bodies[k].split(b"\n")
                lines.append(len(parts))
                if keys:
                    names = {np.array([x["high"], x["low"]], np.int64).tobytes() for x in keys}
                    parts = [x for x in parts if line_key(x, rule.min_chars) not in names]
                    bodies[k] = b"\n".join(parts)
                lost.append(lines[-1] - len(parts))
            columns = [batch.column(name) for name in keep]
            columns[at] = pa.array(bodies, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(lost, pa.int64())], [*keep, *counts])

    return joined.select(*keep, gone).mapInArrow(rewrite, widened(docs, **dict.fromkeys(counts, LongType())))

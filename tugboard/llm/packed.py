"""Rows that carry whole arrays between groups of documents and shards of keys.

A *group* is what one task has read, up to a bound; a *shard* gets one part of every group, by hash.
Shards answer in the order in which they were asked, so answers carry no keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

ROWS = "kind string, grp bigint, shard int, n bigint, a binary, b binary, c binary, d binary, e binary"
NAMES = [field.split()[0] for field in ROWS.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]


def pack(values: np.ndarray) -> bytes:
    """An array, byte place by byte place, compressed: most high bytes are zero."""
    flat = np.ascontiguousarray(values).reshape(-1)
    return zstandard.compress(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes(), 3)


def unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(kind.itemsize, -1)
    return np.array(planes.T, order="C").view(kind).reshape(-1)


def row(kind: str, group: int, shard: int, n: int, *packed: bytes) -> list:
    return [kind, group, shard, int(n), *packed, *[None] * (5 - len(packed))]


def _columns(rows: list[list]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)]


def batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(_columns(rows), NAMES)


def table(rows: list[list]) -> pa.Table:
    return pa.Table.from_arrays(_columns(rows), NAMES)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)

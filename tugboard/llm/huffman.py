"""Length-limited canonical Huffman codes over whole arrays of ids.

Codes are written most significant bit first. Every ``SPACING`` ids the bit offset is noted, and a
block is decoded from all these places at once: step by step one table look-up for each.
"""

from __future__ import annotations

import numpy as np

SPACING = 128
LIMIT = 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The best code lengths of at most ``limit`` bits, 0 for ids that never occur (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    leaves = []  # for each level which of its items, by weight, are single ids
    items = coins
    for _ in range(limit):
        leaf = np.arange(len(items)) < 0 if len(leaves) else np.ones(len(items), bool)
        if leaves:
            pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([coins, pairs])
            place = np.argsort(both, kind="stable")
            items, leaf = both[place], place < len(coins)
        leaves.append(leaf)
    chosen = 2 * len(order) - 2
    for leaf in reversed(leaves):
        singles = int(leaf[:chosen].sum())
        lengths[order[:singles]] += 1
        chosen = 2 * (chosen - singles)
    return lengths


class Code:
    """The canonical code of given lengths: by length, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.width = max(1, int(lengths.max(initial=1)))
        self.codes = np.zeros(len(lengths), np.uint64)
        self.table_ids = np.zeros(1 << self.width, np.int32)
        self.table_lengths = np.ones(1 << self.width, np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = np.int64(1) << (self.width - self.lengths[order])
        begins = np.cumsum(spans) - spans
        self.codes[order] = (begins >> (self.width - self.lengths[order])).astype(np.uint64)
        filled = int(spans.sum())
        self.table_ids[:filled] = np.repeat(order, spans)
        self.table_lengths[:filled] = np.repeat(self.lengths[order], spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of all ids, and the bit offset of every ``SPACING``-th one."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        words = np.zeros(int(ends[-1]) // 64 + 2, np.uint64)
        word, room = starts >> 6, 64 - (starts & 63) - lengths  # room is negative where a code runs over
        codes = self.codes[ids]
        fits = np.maximum(room, 0).astype(np.uint64)
        over = np.maximum(-room, 0).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat((codes << fits) >> over, first)
        run = np.flatnonzero(room < 0)
        words[word[run] + 1] |= codes[run] << (np.uint64(64) - over[run])
        return words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::SPACING]

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """The ids of blocks given as bits, bit offsets and number of ids; all are walked together."""
        lanes, base = [], 0
        for bits, offsets, _ in blocks:
            lanes.append(np.asarray(offsets, np.int64) + 8 * base)
            base += len(bits)
        raw = np.frombuffer(b"".join([*[bits for bits, _, _ in blocks], bytes(8)]), np.uint8).astype(np.uint64)
        window = raw[:-4] << np.uint64(32)
        for k, shift in ((1, 24), (2, 16), (3, 8), (4, 0)):
            window |= raw[k: len(raw) - 4 + k] << np.uint64(shift)
        at = np.concatenate([*lanes, np.zeros(0, np.int64)])
        out = np.empty((SPACING, len(at)), np.int32)
        drop, mask = np.int64(40 - self.width), np.int64((1 << self.width) - 1)
        window, last = window.view(np.int64), len(window) - 1
        for step in range(SPACING):
            peek = (window[np.minimum(at >> 3, last)] >> (drop - (at & 7))) & mask
            out[step] = self.table_ids[peek]
            at += self.table_lengths[peek]
        out = out.T
        found, lane = [], 0
        for _, offsets, count in blocks:
            found.append(out[lane: lane + len(offsets)].reshape(-1)[:count])
            lane += len(offsets)
        return found

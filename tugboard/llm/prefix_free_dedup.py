"""Removes bytes covered by long strings that occur twice, by prefix-free parsing.

A rolling hash over WINDOW bytes triggers a phrase end at about every MEAN-th place, wherever the same
bytes stand. A string of ``length`` bytes is then a suffix of one phrase (the *dictionary* side) and
what follows from its end, the *parse* side; equal strings are cut at the same places. Two strings are
equal if both sides are, and the corpus order of all strings is that of the pair: dictionary suffix
first, then the order of the parse behind it. So neither needs the order of all the corpus's bytes:

1. Every trigger place stands for all strings that reach it first (``Place``). Its *near* key hashes
   what all of them share behind it, its *full* key all bytes that any of them holds. Shards count the
   keys. A full key that occurs twice settles its strings: all are repeated. A near key that has one
   full key only settles the rest: none is. That leaves places where repeats begin or end.
2. The places that are left, one per full key, go to shards by near key. A shard puts their phrase ends
   in order backwards (the suffix array of the dictionary) and what follows in order (the suffix array
   of the parse), with the lengths that neighbours share. For every number of bytes d before the place,
   the two orders fall into classes; strings are equal if both their classes are (``repeated_starts``).
3. Every document's repeated strings are put together and the bytes they cover left out.

Strings without a trigger near their start, as in a run of one letter, are counted by their own hash.
So are those of a near key with over ``hot_places`` full keys: a passage in a third of all documents
would otherwise bring its edges to one task. Keys are 64-bit hashes; what is ordered are the bytes.

Only distinct keys of a group of documents are sent, and the texts travel compressed, once or, where a
repeat begins or ends in them, twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tugboard.llm.packed import NAMES, ROWS, batch, pack, row, shard_of, table, unpack
from tugboard.llm.shared import bounded_batches, fresh, ragged, stored, text_bytes

WINDOW = 12    # bytes that trigger a phrase end
MEAN = 48      # bytes of a phrase on average

SETTLED, MIXED, HOT = 1, 2, 4   # of a class: repeated as a whole; its near key has others; too many others


@dataclass(frozen=True)
class RepeatRule:
    length: int = 400
    reach: int = 240             # bytes before a trigger that it stands for; below ``length`` - WINDOW
    hot_places: int = 20_000     # full keys of one near key that a task may put in order
    group_bytes: int = 12_000_000
    slice_bytes: int = 1_000_000
    seed: int = 1

    @property
    def near(self) -> int:
        return self.length - self.reach


class Hashes:
    """64-bit polynomial hashes of any stretch of a buffer, from running sums."""

    def __init__(self, data: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.values = values = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.weight = base = int(rng.integers(0, 2**61, dtype=np.uint64)) * 8 + 3
        with np.errstate(over="ignore"):
            self.back = self._powers(pow(base, -1, 2**64), len(data) + 1)
            forward = self._powers(base, len(data) + 1)
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * forward[:-1], out=self.sums[1:])

    @staticmethod
    def _powers(base: int, count: int) -> np.ndarray:
        out = np.full(count, np.uint64(base), np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[end] - self.sums[begin]) * self.back[begin]
            return x ^ (x >> np.uint64(32))

    def windows(self, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width]


@dataclass
class Places:
    """Trigger places, and strings that no trigger stands for, of a buffer of documents.

    A place ``at`` stands for the strings that begin ``least`` to ``most`` - 1 bytes before it. A single
    string has no phrase: ``at`` is its begin and its full key 0.
    """
    at: np.ndarray
    least: np.ndarray
    most: np.ndarray
    near: np.ndarray
    full: np.ndarray


def find_places(data: np.ndarray, starts: np.ndarray, rule: RepeatRule) -> Places:
    """The places of documents that lie one after another in ``data``; ``starts`` has the end as its last."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Places(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    hashes = Hashes(data, rule.seed)
    if len(data) >= WINDOW:
        with np.errstate(over="ignore"):
            mixed = hashes.windows(WINDOW) * np.uint64(0x9E3779B97F4A7C15)
        at = np.flatnonzero(mixed >> np.uint64(40) < np.uint64(2**24 // MEAN))
    else:
        at = np.zeros(0, np.int64)
    doc = np.searchsorted(starts, at, side="right") - 1
    inside = at + WINDOW <= starts[doc + 1]
    at, doc = at[inside], doc[inside]
    begins, ends = starts[doc], starts[doc + 1]
    previous = np.concatenate([[-1], at[:-1]])
    previous = np.where(previous < begins, begins - 1, previous)
    most = np.minimum(at - previous, rule.reach)
    least = np.maximum(0, rule.length - (ends - at))
    # Strings between two triggers that begin too far before the second, and those after a document's last.
    cut = np.searchsorted(at, starts)
    last = np.where(cut[1:] > cut[:-1], at[np.maximum(cut[1:] - 1, 0)] if len(at) else 0, starts[:-1] - 1)
    from_ = np.concatenate([previous + 1, last + 1])
    to = np.concatenate([at - most + 1, starts[1:]])
    to = np.minimum(to, np.concatenate([ends, starts[1:]]) - rule.length + 1)
    alone = ragged(from_, np.maximum(to - from_, 0))
    good = most > least
    at, most, least = at[good], most[good], least[good]
    shape = (most * 4096 + least).astype(np.uint64)
    with np.errstate(over="ignore"):
        full = hashes.of(at - most + 1, at + rule.length - least) + (shape + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    near = hashes.of(at, at + rule.near)
    none = np.zeros(len(alone), np.int64)
    return Places(
        np.concatenate([at, alone]), np.concatenate([least, none]), np.concatenate([most, none + 1]),
        np.concatenate([near, hashes.of(alone, alone + rule.length)]),
        np.concatenate([np.where(full == 0, np.uint64(1), full), none.astype(np.uint64)]),
    )


def _classes(near: np.ndarray, full: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (near, full), ordered by shard: the first place of each, and the class of each place."""
    order = np.lexsort((full, near, shard_of(near, shards)))
    n, f = near[order], full[order]
    new = np.ones(len(order), bool)
    new[1:] = (n[1:] != n[:-1]) | (f[1:] != f[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def ask_keys(docs: DataFrame, id: str, text: str, shards: int, rule: RepeatRule) -> DataFrame:
    """Rows ``docs``: a group's texts and places. Rows ``keys``: its distinct keys by shard, with their counts."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        ids, lengths, bodies, found, size = [], [], [], [], 0

        def closed() -> pa.RecordBatch:
            joined = Places(*[np.concatenate([getattr(p, name) for p in found]) for name in Places.__dataclass_fields__])
            first, of = _classes(joined.near, joined.full, shards)
            counts = np.minimum(np.bincount(of, minlength=len(first)), 2).astype(np.uint8)
            near, full = joined.near[first], joined.full[first]
            cuts = np.searchsorted(shard_of(near, shards), np.arange(shards + 1))
            group = task << 24 | turn
            numbers = np.array([-1 if x is None else x for x in ids], np.int64)
            head = np.concatenate([numbers, np.array([x is None for x in ids], np.int64), np.concatenate(lengths)])
            places = np.concatenate([joined.least.astype(np.uint16), joined.most.astype(np.uint16)])
            rows = [row("docs", group, 0, len(ids), pack(head), zstandard.compress(b"".join(bodies), 5), pack(joined.at.astype(np.uint32)), pack(places), pack(of.astype(np.uint32)))]
            for s in range(shards):
                part = slice(cuts[s], cuts[s + 1])
                rows.append(row("keys", group, s, cuts[s + 1] - cuts[s], pack(near[part]), pack(full[part]), pack(counts[part])))
            return batch(rows)

        for read in batches:
            data, starts = text_bytes(read.column(1))
            doc = 0
            while doc < len(read):
                end = max(doc + 1, int(np.searchsorted(starts, starts[doc] + rule.slice_bytes, side="right")) - 1)
                part = data[starts[doc]: starts[end]]
                places = find_places(part, starts[doc: end + 1] - starts[doc], rule)
                places.at = places.at + size
                ids += read.column(0).slice(doc, end - doc).to_pylist()
                lengths.append(np.diff(starts[doc: end + 1]))
                bodies.append(part.tobytes())
                found.append(places)
                size, doc = size + len(part), end
                if size >= rule.group_bytes:
                    yield closed()
                    turn += 1
                    ids, lengths, bodies, found, size = [], [], [], [], 0
        if ids:
            yield closed()

    taken = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return taken.mapInArrow(parse, ROWS)


def answer_keys(asked: DataFrame, rule: RepeatRule) -> DataFrame:
    """Rows ``flags`` for each group and shard: what is known of each key now."""
    def answer(key: tuple, part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        near = np.concatenate([unpack(r["a"], np.uint64) for r in rows])
        full = np.concatenate([unpack(r["b"], np.uint64) for r in rows])
        counts = np.concatenate([unpack(r["c"], np.uint8) for r in rows])
        first, of = _classes(near, full, 1)
        total = np.bincount(of, counts, len(first))
        _, bucket, others = np.unique(near[first], return_inverse=True, return_counts=True)
        flags = (total > 1) * SETTLED + (others[bucket] > 1) * MIXED + (others[bucket] > rule.hot_places) * HOT
        flags = flags.astype(np.uint8)[of]
        out, at = [], 0
        for r in rows:
            out.append(row("flags", r["grp"], key[0].as_py(), r["n"], pack(flags[at: at + r["n"]])))
            at += r["n"]
        return table(out)

    return asked.groupBy("shard").applyInArrow(answer, ROWS)


def _texts_of(docs: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    head = unpack(docs["a"], np.int64).reshape(3, -1)
    return head[0], head[1].astype(bool), np.concatenate([[0], np.cumsum(head[2])]), np.frombuffer(zstandard.decompress(docs["b"]), np.uint8)


def _results(ids, no_id, starts, data, begins: np.ndarray, length: int, chosen: np.ndarray, keep: bool) -> list[bytes]:
    """What stays of the documents ``chosen``, given where repeated strings begin in the buffer."""
    begins = np.sort(begins)
    cuts = np.searchsorted(begins, starts)
    digests, spans, counts, kept = [], [], [], []
    for doc in np.flatnonzero(chosen):
        body, own = data[starts[doc]: starts[doc + 1]], begins[cuts[doc]: cuts[doc + 1]] - starts[doc]
        if len(own):
            new = np.flatnonzero(np.diff(own, prepend=own[0] - length - 1) > length)
            span = np.stack([own[new], own[np.append(new[1:], len(own)) - 1] + length], axis=1)
            edges = [0, *span.reshape(-1).tolist(), len(body)]
            rest = b"".join(body[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))
        else:
            span, rest = np.zeros((0, 2), np.int64), body.tobytes()
        digests.append(hashlib.sha256(rest).digest())
        spans.append(span.reshape(-1))
        counts.append(len(span))
        kept.append(rest if keep else b"")
    head = np.concatenate([ids[chosen], no_id[chosen].astype(np.int64), np.diff(starts)[chosen], np.array(counts, np.int64), np.array([len(x) for x in kept], np.int64)])
    return [pack(head), pack(np.concatenate([*spans, np.zeros(0, np.int64)])), b"".join(digests), zstandard.compress(b"".join(kept), 1)]


def _hash_each(data: np.ndarray, begins: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The hashes that ``Hashes`` gives for stretches of one width, a few thousand at a time."""
    unit = Hashes(np.zeros(width, np.uint8), seed)
    weights = np.array([unit.weight ** k % 2**64 for k in range(width)], np.uint64)
    out = np.empty(len(begins), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(begins), 4096):
            letters = data[begins[k: k + 4096, None] + np.arange(width)]
            x = (unit.values[letters] * weights).sum(axis=1, dtype=np.uint64)
            out[k: k + 4096] = x ^ (x >> np.uint64(32))
    return out


def ask_places(groups: DataFrame, shards: int, rule: RepeatRule, keep: bool) -> DataFrame:
    """From a group's ``docs`` and ``flags`` rows: ``done``, its documents that are settled; ``open``, the
    others, which refers to the places asked about in ``places`` and the strings asked about in ``strings``."""
    def ask(key: tuple, part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        docs = next(r for r in rows if r["kind"] == "docs")
        group = docs["grp"]
        flags = np.concatenate([unpack(r["a"], np.uint8) for r in sorted((r for r in rows if r["kind"] == "flags"), key=lambda r: r["shard"])])
        ids, no_id, starts, data = _texts_of(docs)
        at, of = unpack(docs["c"], np.uint32).astype(np.int64), unpack(docs["e"], np.uint32).astype(np.int64)
        least, most = unpack(docs["d"], np.uint16).astype(np.int64).reshape(2, -1)
        flag, doc = flags[of], np.searchsorted(starts, at, side="right") - 1
        settled = np.flatnonzero(flag & SETTLED)
        begins = ragged(at[settled] - most[settled] + 1, most[settled] - least[settled])
        pending = np.flatnonzero((flag & (SETTLED | MIXED)) == MIXED)
        is_open = np.zeros(len(ids), bool)
        is_open[doc[pending]] = True
        out = [row("done", group, 0, (~is_open).sum(), *_results(ids, no_id, starts, data, begins, rule.length, ~is_open, keep))]

        # One place of each mixed class, also of those that are settled: others may equal their strings.
        mixed = np.flatnonzero(flag & MIXED)
        classes, first = np.unique(of[mixed], return_index=True)
        asked, hot = mixed[first], (flags[classes] & HOT) > 0
        cold = asked[~hot]
        near = _hash_each(data, at[cold], rule.near, rule.seed)
        cuts = np.searchsorted(shard_of(near, shards), np.arange(shards + 1))  # classes are in the order of their shards
        for s in np.flatnonzero(np.diff(cuts)):
            own = cold[cuts[s]: cuts[s + 1]]
            left = data[ragged(at[own] - most[own] + 1, most[own] - 1)]
            right = data[ragged(at[own] + rule.near, rule.reach - least[own])]
            out.append(row("places", group, s, len(own), pack(near[cuts[s]: cuts[s + 1]]), pack(np.concatenate([least[own], most[own]]).astype(np.uint16)),
                           zstandard.compress(left.tobytes(), 3), zstandard.compress(right.tobytes(), 3)))
        warm = asked[hot]
        strings = _hash_each(data, ragged(at[warm] - most[warm] + 1, most[warm] - least[warm]), rule.length, rule.seed)
        distinct, where, counts = np.unique(strings, return_inverse=True, return_counts=True)
        order = np.argsort(shard_of(distinct, shards), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        distinct, counts = distinct[order], np.minimum(counts[order], 2).astype(np.uint8)
        cuts = np.searchsorted(shard_of(distinct, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[s], cuts[s + 1])
            out.append(row("strings", group, s, cuts[s + 1] - cuts[s], pack(distinct[own]), pack(counts[own])))

        # What is needed to finish the open documents once the answers are there.
        opened = np.flatnonzero(is_open)
        lengths = np.diff(starts)[opened]
        moved = np.zeros(len(ids), np.int64)
        moved[opened] = np.cumsum(lengths) - lengths - starts[opened]
        sure = begins[is_open[np.searchsorted(starts, begins, side="right") - 1]]
        sure = sure + moved[np.searchsorted(starts, sure, side="right") - 1]
        slot = np.searchsorted(classes, of[pending])
        is_hot = hot[slot]
        slot = np.where(is_hot, np.cumsum(hot)[slot] - 1, np.cumsum(~hot)[slot] - 1)
        refs = np.stack([at[pending] + moved[doc[pending]], most[pending], least[pending], slot, is_hot.astype(np.int64)])
        sizes = most[warm] - least[warm]
        head = np.concatenate([ids[opened], no_id[opened].astype(np.int64), lengths])
        text = data[ragged(starts[opened], lengths)].tobytes()
        if len(opened):
            out.append(row("open", group, 0, len(opened), pack(head), zstandard.compress(text, 5), pack(sure), pack(refs),
                           pack(np.concatenate([[len(sizes)], np.cumsum(sizes) - sizes, place[where]]).astype(np.int64))))
        return table(out)

    return groups.groupBy("grp").applyInArrow(ask, ROWS)


def _neighbours(order: np.ndarray, bucket: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """How many letters each row shares with the one before it in ``order``; -1 with one of another bucket."""
    shared = np.full(len(order), -1, np.int64)
    for k in range(1, len(order), 65536):
        now, before = order[k: k + 65536], order[k - 1: k - 1 + len(order[k: k + 65536])]
        differ = letters[now] != letters[before]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), letters.shape[1])
        shared[k: k + 65536] = np.where(bucket[now] == bucket[before], same, -1)
    return shared


def _suffix_order(bucket: np.ndarray, letters: np.ndarray) -> np.ndarray:
    words = np.pad(letters, ((0, 0), (0, -letters.shape[1] % 8))).view(">u8").astype(np.uint64)
    return np.lexsort((*words.T[::-1], bucket))


def repeated_starts(near: np.ndarray, least: np.ndarray, most: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int) -> np.ndarray:
    """For each place and each d below ``reach`` whether the string that begins d bytes before it occurs twice.

    ``left`` has the bytes before a place, nearest first, ``right`` those behind its near key; both are
    filled up with zeros, which no string that is asked about holds. Both sides are put in order once.
    For a given d, neighbours that share fewer than d bytes to the left, or too few to the right, bound
    the classes of the two orders; equal strings are those equal in both.
    """
    _, bucket = np.unique(near, return_inverse=True)
    dictionary, parse = _suffix_order(bucket, left), _suffix_order(bucket, right)
    shared_left, shared_right = _neighbours(dictionary, bucket, left), _neighbours(parse, bucket, right)
    found = np.zeros((len(near), reach), bool)
    left_class, right_class = np.empty(len(near), np.uint64), np.empty(len(near), np.uint64)
    for d in range(reach):
        rows = np.flatnonzero((least <= d) & (d < most))
        if len(rows) < 2:
            continue
        left_class[dictionary] = np.cumsum(shared_left < d)
        right_class[parse] = np.cumsum(shared_right < reach - d)
        _, which, times = np.unique(left_class[rows] << np.uint64(32) | right_class[rows], return_inverse=True, return_counts=True)
        found[rows, d] = times[which] > 1
    return found


def _filled(lengths: np.ndarray, data: bytes, width: int, backwards: bool) -> np.ndarray:
    out = np.zeros((len(lengths), width), np.uint8)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    columns = ragged(np.zeros(len(lengths), np.int64), lengths)
    if backwards:
        columns = np.repeat(lengths, lengths) - 1 - columns
    out[rows, columns] = np.frombuffer(data, np.uint8)
    return out


def answer_places(asked: DataFrame, rule: RepeatRule) -> DataFrame:
    """Rows ``starts`` for ``places``: a row of bits for each place; ``twice`` for ``strings``: a byte each."""
    def answer(key: tuple, part: pa.Table) -> pa.Table:
        shard, out = key[0].as_py(), []
        rows = [r for r in part.to_pylist() if r["kind"] == "places"]
        if rows:
            near = np.concatenate([unpack(r["a"], np.uint64) for r in rows])
            shapes = [unpack(r["b"], np.uint16).astype(np.int64).reshape(2, -1) for r in rows]
            left = np.concatenate([_filled(m - 1, zstandard.decompress(r["c"]), rule.reach, True) for (_, m), r in zip(shapes, rows, strict=True)])
            right = np.concatenate([_filled(rule.reach - n, zstandard.decompress(r["d"]), rule.reach, False) for (n, _), r in zip(shapes, rows, strict=True)])
            least, most = np.concatenate(shapes, axis=1)
            found = np.packbits(repeated_starts(near, least, most, left, right, rule.reach), axis=1)
            at = 0
            for r in rows:
                out.append(row("starts", r["grp"], shard, r["n"], pack(found[at: at + r["n"]])))
                at += r["n"]
        rows = [r for r in part.to_pylist() if r["kind"] == "strings"]
        if rows:
            distinct, where = np.unique(np.concatenate([unpack(r["a"], np.uint64) for r in rows]), return_inverse=True)
            twice = np.bincount(where, np.concatenate([unpack(r["b"], np.uint8) for r in rows]), len(distinct))[where] > 1
            at = 0
            for r in rows:
                out.append(row("twice", r["grp"], shard, r["n"], pack(twice[at: at + r["n"]])))
                at += r["n"]
        return table(out)

    return asked.groupBy("shard").applyInArrow(answer, ROWS)


def finish(groups: DataFrame, rule: RepeatRule, keep: bool) -> DataFrame:
    """``done`` rows from a group's ``open`` row and the answers to it."""
    width = (rule.reach + 7) // 8

    def end(key: tuple, part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["shard"])
        opened = next((r for r in rows if r["kind"] == "open"), None)
        if opened is None:  # the group only asked on behalf of others
            return table([])
        ids, no_id, starts, data = _texts_of(opened)
        at, most, least, slot, is_hot = unpack(opened["d"], np.int64).reshape(5, -1)
        bits = np.concatenate([np.zeros(0, np.uint8), *[unpack(r["a"], np.uint8) for r in rows if r["kind"] == "starts"]]).reshape(-1, width)
        twice = np.concatenate([np.zeros(0, bool), *[unpack(r["a"], bool) for r in rows if r["kind"] == "twice"]])
        cold, warm = np.flatnonzero(is_hot == 0), np.flatnonzero(is_hot)
        place, d = np.nonzero(np.unpackbits(bits[slot[cold]], axis=1, count=rule.reach))
        strings = unpack(opened["e"], np.int64)
        offsets, which = strings[1: 1 + strings[0]], strings[1 + strings[0]:]
        hot_begins = ragged(at[warm] - most[warm] + 1, most[warm] - least[warm])
        hot_found = twice[which[ragged(offsets[slot[warm]], most[warm] - least[warm])]]
        begins = np.concatenate([unpack(opened["c"], np.int64), at[cold][place] - d, hot_begins[hot_found]])
        return table([row("done", opened["grp"], 0, len(ids), *_results(ids, no_id, starts, data, begins, rule.length, np.ones(len(ids), bool), keep))])

    return groups.groupBy("grp").applyInArrow(end, ROWS)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: RepeatRule = RepeatRule(), with_kept: bool = False) -> DataFrame:
    """``id, n_bytes, begins, ends, kept_sha256`` of every row, and ``kept`` if wanted.

    A text's UTF-8 bytes that are covered by a string of ``length`` bytes which also begins elsewhere, in
    any row or the same one, overlaps included, are removed: the spans ``begins[k]`` to ``ends[k]``. What is
    kept may not be whole UTF-8, so it is binary. Null texts are empty, short ones are kept whole, rows
    that repeat are copies of each other, also where they share an id; a table without rows gives none.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = ["n_bytes", "begins", "ends", "kept_sha256", *["kept"] * with_kept]
    names = [*fresh(own, id), *own]
    shards = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = stored(ask_keys(docs, id, text, shards, rule), "kind")
    flags = answer_keys(groups.where("kind = 'keys'").select(*NAMES), rule)
    asked = stored(ask_places(groups.where("kind = 'docs'").select(*NAMES).unionByName(flags), shards, rule, with_kept), "kind").select(*NAMES)
    answers = answer_places(asked.where("kind in ('places', 'strings')"), rule)
    done = asked.where("kind = 'done'").unionByName(finish(asked.where("kind = 'open'").unionByName(answers), rule, with_kept))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for read in batches:
            for r in read.to_pylist():
                ids, no_id, lengths, counts, sizes = unpack(r["a"], np.int64).reshape(5, -1)
                spans, ends = unpack(r["b"], np.int64), np.concatenate([[0], np.cumsum(2 * counts)])
                begin_lists = pa.ListArray.from_arrays(pa.array(ends // 2, pa.int32()), pa.array(spans[::2]))
                end_lists = pa.ListArray.from_arrays(pa.array(ends // 2, pa.int32()), pa.array(spans[1::2]))
                digests = [r["c"][k: k + 32].hex() for k in range(0, len(r["c"]), 32)]
                columns = [pa.array(ids, mask=no_id != 0), pa.array(lengths), begin_lists, end_lists, pa.array(digests, pa.string())]
                if with_kept:
                    kept, stops = zstandard.decompress(r["d"]), np.concatenate([[0], np.cumsum(sizes)]).tolist()
                    columns.append(pa.array([kept[a:b] for a, b in zip(stops, stops[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{names[0]}` bigint, n_bytes bigint, begins array<bigint>, ends array<bigint>, kept_sha256 string" + ", kept binary" * with_kept
    return done.mapInArrow(unfold, schema)

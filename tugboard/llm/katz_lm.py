"""Scores texts by an n-gram model with Katz backoff, learned from the same corpus.

Grams of two tokens up to ``order`` tokens are counted. One seen in training has its Good-Turing discounted
share of its context (all tokens but its last); any other has what its last tokens have by the order below,
times a backoff weight that makes the context sum to one exactly. A context never seen leaves all to the
order below. A token never seen has the probability that discounting took from the single tokens. All unseen
tokens are one. Before a document's first token the context is START as often as it takes.

The texts are read once. Each task numbers the words of its documents (a *group*, a few million tokens)
and keeps the documents as arrays of these numbers. From then on only what is distinct in a group moves:

1. ``words``: hashes of the group's words, dealt to shards by hash, with their counts in training. A
   shard adds up all groups and answers each with the ids and counts of its words, in the order asked.
2. ``grams``, order by order: the group's grams as ids, dealt by context, with their counts. A shard adds
   up and answers with the counts of the grams and, per context, what its backoff weight needs. That is a
   sum over tokens seen after the context, whose shares by the order below the groups have learned by then.
3. Each group puts the scores of its documents together, its grams worked out once more: they would
   take more room than its texts.

The tables of groups and of all answers are partitioned Parquet in the shared folder, so a lost
executor repeats a part of one step. A shard is a task; the number of shards follows the number of
distinct rows sent. A context as common as 1/HOT_SHARE of all tokens is dealt by gram instead, and its
few sums are added up afterwards.

Words, and common contexts of several tokens, are told apart by a 64-bit hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tugboard.llm.packed import NAMES, ROWS, batch, pack, row, shard_of, table, unpack
from tugboard.llm.shared import bounded_batches, fresh, stored, texts

UNKNOWN, START, FIRST = 0, 1, 2   # ids: of unseen words, of the context before the first token, of the first word
HOT_SHARE = 1000


@dataclass(frozen=True)
class KatzRule:
    order: int = 2                  # tokens of the longest grams counted
    folds: int = 5
    held_out_fold: int = 1
    discounted: int = 5             # counts up to this one are discounted
    group_tokens: int = 2_200_000   # of the documents a task keeps at a time
    shard_rows: int = 1_000_000     # distinct words or grams, summed over the groups, aimed at per shard
    passes: int = 2                 # in which the shards of an order are asked, one after another: of its grams, a share moves at a time


class Numbering(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def discounts(seen: np.ndarray, most: int) -> np.ndarray:
    """What counts 0..most are worth by Good-Turing, given how many things were seen r times (``seen[r]``).

    Katz's renormalised form. Where that is not between 0 and r (few data), r less a fixed part of one.
    """
    worth = np.arange(most + 1, dtype=np.float64)
    n = seen.astype(np.float64)
    part = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    common = (most + 1) * n[most + 1] / n[1] if n[1] else 1.0
    for r in range(1, most + 1):
        turing = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        better = r * (turing / r - common) / (1 - common) if common < 1 else 0.0
        worth[r] = better if 0 < better < r else r - part
    return worth


class Single:
    """Probabilities of single tokens: discounted counts; what is left over belongs to unseen ones."""

    def __init__(self, tokens: int, seen: np.ndarray, most: int):
        self.worth = discounts(seen, most)
        lost = float((seen[1: most + 1] * (np.arange(1, most + 1) - self.worth[1:])).sum())
        self.total = tokens if lost > 0 else tokens + 1
        self.unseen = lost / tokens if lost > 0 else 1 / self.total

    def of(self, counts: np.ndarray) -> np.ndarray:
        small = np.minimum(counts, len(self.worth) - 1)
        worth = np.where(counts < len(self.worth), self.worth[small], counts)
        return np.where(counts > 0, worth / self.total, self.unseen)


def numbered_groups(docs: DataFrame, id: str, text: str, shards: int, rule: KatzRule) -> DataFrame:
    """Rows ``docs``: the documents of a group as numbers of its words. Rows ``words``: its words by shard.

    The words of a group are numbered by (shard, hash), so the shards' answers, one after another, are
    in the order of the numbers. ``shards`` is the number of word shards.
    """
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        words, docs_now, tokens, size = Numbering({b" ": 0}), [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.array([-1 if doc is None else doc for doc in docs_now], np.int64)
            known = np.array([doc is not None for doc in docs_now], bool)
            held = np.array([doc is not None and zlib.crc32(str(doc).encode()) % rule.folds == rule.held_out_fold for doc in docs_now], bool)
            lengths = np.array([len(x) for x in tokens], np.int64)
            flat = np.concatenate(tokens)
            hashes = np.fromiter((xxhash.xxh64_intdigest(word) for word in words), np.uint64, len(words))
            order = np.lexsort((hashes, shard_of(hashes, shards)))
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            hashes, flat = hashes[order], place[flat]
            trained = np.bincount(flat[np.repeat(~held, lengths)], minlength=len(order))
            group = task << 24 | turn
            rows = [
                row("docs", group, 0, int(trained.sum()), pack(ids), pack(known), pack(held), pack(lengths), pack(flat)),
                row("size", group, 0, len(flat)),
            ]
            cuts = np.searchsorted(shard_of(hashes, shards), np.arange(shards + 1))
            rows += [
                row("words", group, s, int(cuts[s + 1] - cuts[s]), pack(hashes[cuts[s]: cuts[s + 1]]), pack(trained[cuts[s]: cuts[s + 1]].astype(np.uint32)))
                for s in range(shards)
            ]
            return batch(rows)

        for read in batches:
            for doc, body in zip(read.column(0).to_pylist(), texts(read.column(1)), strict=True):
                numbers = list(map(words.__getitem__, body.lower().split()))
                numbers.append(0)  # the end; no word has a space in it
                docs_now.append(doc)
                tokens.append(np.array(numbers, np.uint32))
                size += len(numbers)
                if size >= rule.group_tokens:
                    yield closed()
                    turn += 1
                    words, docs_now, tokens, size = Numbering({b" ": 0}), [], [], 0
        if docs_now:
            yield closed()

    taken = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return taken.mapInArrow(number, ROWS)


def _added_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(where, np.concatenate(counts), len(distinct)).astype(np.int64), where


def _histogram(counts: np.ndarray, most: int) -> np.ndarray:
    return np.bincount(np.minimum(counts, most + 2), minlength=most + 3)[: most + 2].astype(np.int64)


def word_answers(asked: DataFrame, shards: int, hot: int, rule: KatzRule) -> DataFrame:
    """Rows ``answer`` (ids, counts) for each group and shard; ``seen``: a shard's counts of counts; ``hot``: common words."""
    def answer(key: tuple, part: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys = [unpack(x, np.uint64) for x in part.column("a").to_pylist()]
        distinct, counts, where = _added_up(keys, [unpack(x, np.uint32) for x in part.column("b").to_pylist()])
        rank = np.empty(len(distinct), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(distinct))  # common words have small ids, which pack better
        ids = np.where(counts > 0, FIRST + rank * shards + shard, UNKNOWN).astype(np.uint64)
        common = np.flatnonzero(counts > hot)
        rows = [
            row("seen", -1, shard, int((counts > 0).sum()), pack(_histogram(counts, rule.discounted))),
            row("hot", -1, shard, len(common), pack(ids[common])),
        ]
        at = 0
        for group, own in zip(part.column("grp").to_pylist(), keys, strict=True):
            mine = where[at: at + len(own)]
            rows.append(row("answer", group, shard, len(own), pack(ids[mine]), pack(counts[mine])))
            at += len(own)
        return table(rows)

    return asked.groupBy("shard").applyInArrow(answer, ROWS)


def valued(counts: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Counts after discounting."""
    return np.where(counts < len(worth), worth[np.minimum(counts, len(worth) - 1)], counts)


def numbers_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and for each key its number among them.

    Where a key and a place fit in 64 bits, they are sorted as one number, several times as fast as sorting places by keys.
    """
    places = np.uint64(max(1, len(keys) - 1).bit_length())
    if not len(keys) or int(keys.max()).bit_length() + int(places) > 64:
        return np.unique(keys, return_inverse=True)
    both = np.sort(keys.astype(np.uint64) << places | np.arange(len(keys), dtype=np.uint64))
    place = (both & ((np.uint64(1) << places) - np.uint64(1))).astype(np.int64)
    both >>= places
    new = np.append(True, both[1:] != both[:-1])
    number = np.empty(len(keys), np.int64)
    number[place] = np.cumsum(new) - 1
    return both[new], number


def joined(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Pairs of small numbers as one number, in the order of the pairs, and how many bits the lower ones take."""
    bits = np.uint64(int(low.max(initial=0)).bit_length())
    return high.astype(np.uint64) << bits | low.astype(np.uint64), bits


def among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among ``some``, which are ascending and not none."""
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def alike(columns: list[np.ndarray], n: int) -> np.ndarray:
    """A number for each of ``n`` rows of ids, from 0 without gaps: equal rows have the same one."""
    number = np.zeros(n, np.int64)
    for column in columns:
        number = numbers_of(joined(number, numbers_of(column)[1])[0])[1]
    return number


def longer_keys(keys: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Keys of contexts with one more token at their end; the key of a single token is its id."""
    return (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + tokens


@dataclass(frozen=True)
class Order:
    """What all groups must know of the grams of one order. Fields from ``worth`` on come with the answers."""

    shards: int
    hot: np.ndarray                  # keys of common contexts, ascending
    worth: np.ndarray | None = None
    rare: np.ndarray | None = None   # of the common contexts: the grams seen once, twice, ...,
    whole: np.ndarray | None = None  # all of their counts,
    share: np.ndarray | None = None  # and what the tokens seen after them have by the order below


class Level:
    """The distinct grams of one order in a group, in the order of (shard, context, token), so that the shards'
    answers, one after another, are in this order. ``of`` has the gram of each token, ``below`` each gram's last
    tokens as a gram of the order below. A context is numbered as a gram of the order below; the number after the
    last is that of START all along."""

    def __init__(self, order: Order, flat: np.ndarray, first: np.ndarray, ids: np.ndarray, before: np.ndarray, keys: np.ndarray, heads: list[np.ndarray]):
        """``before``: grams of the order below of each token; ``keys``, ``heads``: keys and ids of those grams and START."""
        context = np.empty_like(flat)
        context[1:] = before[:-1]
        context[first] = len(keys) - 1
        # Numbers within the group fit in 32 bits, so a context and a token are one number.
        pairs, bits = joined(context, flat)
        grams, place = numbers_of(pairs)
        contexts, tokens = (grams >> bits).astype(np.uint32), (grams & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.uint32)
        del context, pairs, grams
        own = keys[contexts]
        shard = shard_of(np.where(among(keys, order.hot)[contexts], own * np.uint64(0x2545F4914F6CDD1D) + ids[tokens], own), order.shards)
        del own
        turn = np.argsort(shard.astype(np.uint16) if order.shards <= 1 << 16 else shard, kind="stable")  # 16 bits: a radix sort
        moved = np.empty(len(turn), np.uint32)
        moved[turn] = np.arange(len(turn), dtype=np.uint32)
        self.of, self.contexts, self.tokens = moved[place], contexts[turn], tokens[turn]
        self.cuts = np.searchsorted(shard[turn], np.arange(order.shards + 1))
        self.below = np.empty(len(turn), np.uint32)
        self.below[self.of] = before
        self.keys, self.heads = keys, heads

    def runs(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the contexts of a shard begin among its grams, and how many grams each has."""
        own = self.contexts[self.cuts[shard]: self.cuts[shard + 1]]
        starts = np.flatnonzero(np.diff(own.astype(np.int64), prepend=-1))
        return starts, np.diff(np.append(starts, len(own))).astype(np.uint32)

    def learn(self, rows: list[dict], order: Order, lower: np.ndarray) -> None:
        """Take the shards' answers. ``lower``: the probability of each gram by the order below."""
        most = len(order.worth) - 1
        self.counts, self.totals, self.chance = np.zeros(len(self.tokens), np.int64), np.zeros(len(self.tokens), np.int64), np.empty(len(self.tokens))
        for r in rows:
            own = slice(self.cuts[r["shard"]], self.cuts[r["shard"] + 1])
            starts, runs = self.runs(r["shard"])
            keys = self.keys[self.contexts[own][starts]]
            rare, total, share = unpack(r["b"], np.uint32).astype(np.int64).reshape(-1, most), unpack(r["c"], np.int64), unpack(r["d"], np.float64)
            common = np.flatnonzero(among(keys, order.hot))
            at = np.searchsorted(order.hot, keys[common])
            rare[common], total[common], share[common] = order.rare[at], totals_of(order.whole[at], order.rare[at]), order.share[at]
            counts, totals = unpack(r["a"], np.int64), np.repeat(total, runs)
            backoff = np.repeat(backoffs(rare, total, share, order.worth), runs)
            self.counts[own], self.totals[own] = counts, totals
            self.chance[own] = np.where(counts > 0, valued(counts, order.worth) / np.maximum(totals, 1), backoff * lower[own])


def totals_of(whole: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """What counts are divided by: a context without counts to discount gives up a share of one."""
    return np.where(whole > 0, whole + (rare.sum(axis=1) == 0), 0)


def backoffs(rare: np.ndarray, total: np.ndarray, share: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """The weight of the order below in each context; one where the context was never seen."""
    lost = rare @ (np.arange(1, len(worth)) - worth[1:])
    left = np.where(lost > 0, lost, 1) / np.maximum(total, 1)
    return np.where(total > 0, left / np.maximum(1 - share, 1e-300), 1.0)


class Group:
    """A group, from its ``docs`` row, its ``answer`` rows to ``words``, and its ``counts`` rows of all orders but the last or of all."""

    def __init__(self, rows: list[dict], orders: list[Order], single: Single):
        docs = next(r for r in rows if r["kind"] == "docs")
        answers = sorted((r for r in rows if r["kind"] == "answer"), key=lambda r: r["shard"])
        ids = np.concatenate([unpack(r["a"], np.uint64) for r in answers])
        self.counts = np.concatenate([unpack(r["b"], np.int64) for r in answers])
        self.number, self.ids, self.known = docs["grp"], unpack(docs["a"], np.int64), unpack(docs["b"], bool)
        self.held, self.lengths = unpack(docs["c"], bool), unpack(docs["d"], np.int64)
        self.flat = unpack(docs["e"], np.uint32)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.words, self.level = ids, None
        # Of the order below: grams of tokens, keys, ids, counts, what these are divided by, and probabilities.
        start = np.array([START], np.uint64)
        before, keys = self.flat, np.append(ids, start)
        heads, counts, totals, chance = [keys], self.counts, np.full(len(ids), single.total, np.int64), single.of(self.counts)
        for k, order in enumerate(orders, 2):
            level = Level(order, self.flat, self.first, ids, before, keys, heads)
            self.level, self.lower_counts, self.lower_totals = level, counts, totals
            if order.worth is None:
                return
            level.learn([r for r in rows if r["kind"] == f"counts{k}"], order, chance[level.below])
            if k == len(orders) + 1:
                self.chance = level.chance[level.of]
                return
            before, counts, totals, chance = level.of, level.counts, level.totals, level.chance
            heads = [*(np.append(x[level.contexts], start) for x in heads), np.append(ids[level.tokens], start)]
            keys = heads[0]
            for more in heads[1:]:
                keys = longer_keys(keys, more)
        self.chance = chance[before]

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first)


def grams_of_groups(groups: DataFrame, orders: list[Order], single: Single, shards: range) -> DataFrame:
    """A row ``grams`` of the last order for each group and each of ``shards``: ``a`` the ids of each context's tokens, all first ones,
    then all second ones, ..., then, for each different row of last tokens in the order of ``alike``, what counts in these are divided by;
    ``b`` how many grams each context has, ``c`` their tokens, ``d`` the counts of their last tokens by the order below, ``e`` their counts
    in the group's training texts."""
    def gram(key: tuple, part: pa.Table) -> pa.Table:
        group = Group(part.to_pylist(), orders, single)
        level = group.level
        trained = np.bincount(level.of, np.repeat(~group.held, group.lengths), len(level.tokens)).astype(np.uint32)
        out = []
        for s in np.flatnonzero(np.diff(level.cuts)):
            if s not in shards:
                continue
            own = slice(level.cuts[s], level.cuts[s + 1])
            starts, runs = level.runs(s)
            contexts, below = level.contexts[own][starts], level.below[own]
            heads = [x[contexts] for x in level.heads]
            first = np.unique(alike(heads[1:], len(contexts)), return_index=True)[1]
            totals = group.lower_totals[below[starts[first]]].astype(np.uint64)
            lower = np.where(trained[own] > 0, group.lower_counts[below], 0)  # asked for where it was seen
            out.append(row("grams", group.number, s, own.stop - own.start, pack(np.concatenate([*heads, totals])),
                           pack(runs), pack(group.words[level.tokens[own]]), pack(lower), pack(trained[own])))
        return table(out)

    return groups.groupBy("grp").applyInArrow(gram, ROWS)


def gram_answers(asked: DataFrame, order: int, hot: np.ndarray, often: int, below: np.ndarray, rule: KatzRule) -> DataFrame:
    """Rows ``counts`` for each group and shard: ``a`` counts of its grams, and for each of its contexts in turn ``c`` what
    counts are divided by and, where the group has a gram that was never seen, ``b`` the grams seen once, twice, ..., ``d`` what
    the tokens seen after it have by the order below. ``seen``: counts of counts. ``hot``: the sums of the common contexts'
    parts. ``often``: keys of the grams seen more than ``often`` times. ``below``: what counts of the order below are worth."""
    most = rule.discounted

    def answer(key: tuple, part: pa.Table) -> pa.Table:
        shard, rows = key[0].as_py(), part.to_pylist()
        runs = [unpack(r["b"], np.uint32) for r in rows]
        tokens, divided = [], []
        for r, own in zip(rows, runs, strict=True):
            sent = unpack(r["a"], np.uint64)
            ids, totals = sent[: (order - 1) * len(own)].reshape(order - 1, -1), sent[(order - 1) * len(own):]
            tokens.append(ids)
            divided.append(totals[alike(list(ids[1:]), len(own))].astype(np.int64))
        sent = np.concatenate(tokens, axis=1)
        head, keys = alike(list(sent), sent.shape[1]), sent[0]
        for more in sent[1:]:
            keys = longer_keys(keys, more)
        heads = int(head.max()) + 1
        key_of, total_below = np.empty(heads, np.uint64), np.empty(heads, np.int64)
        key_of[head], total_below[head] = keys, np.concatenate(divided)
        del sent, keys, tokens, divided
        tails, tail = numbers_of(np.concatenate([unpack(r["c"], np.uint64) for r in rows]))
        pairs, bits = joined(np.repeat(head, np.concatenate(runs)), tail)
        grams, place = numbers_of(pairs)
        del pairs, tail
        trained = np.concatenate([unpack(r["e"], np.uint32) for r in rows])
        counts = np.bincount(place, trained, len(grams)).astype(np.int64)
        lower, learned = np.zeros(len(grams), np.int64), trained > 0
        lower[place[learned]] = np.concatenate([unpack(r["d"], np.int64) for r in rows])[learned]
        of = (grams >> bits).astype(np.int64)
        seen = counts > 0
        share = np.bincount(of[seen], valued(lower[seen], below), heads) / np.maximum(total_below, 1)
        whole = np.bincount(of, counts, heads).astype(np.int64)
        rare = np.stack([np.bincount(of[counts == r], minlength=heads) for r in range(1, most + 1)], axis=1).astype(np.uint32)
        total, common, many = totals_of(whole, rare), np.flatnonzero(among(key_of, hot)), np.flatnonzero(counts > often)
        out = [
            row("seen", -1, shard, 0, pack(_histogram(counts, most))),
            row("hot", -1, shard, len(common), pack(key_of[common]), pack(rare[common]), pack(whole[common]), pack(share[common])),
        ]
        if order < rule.order:
            out.append(row("often", -1, shard, len(many), pack(longer_keys(key_of[of[many]], tails[grams[many] & ((np.uint64(1) << bits) - np.uint64(1))]))))
        at = now = 0
        for r, own in zip(rows, runs, strict=True):
            mine, h = counts[place[at: at + r["n"]]], head[now: now + len(own)]
            missed = np.minimum.reduceat(mine, np.cumsum(own, dtype=np.int64) - own) == 0
            out.append(row(f"counts{order}", r["grp"], shard, r["n"], pack(mine), pack(np.where(missed[:, None], rare[h], np.uint32(0))),
                           pack(total[h]), pack(np.where(missed, share[h], 0.0))))
            at, now = at + r["n"], now + len(own)
        return table(out)

    return asked.groupBy("shard").applyInArrow(answer, ROWS)


def group_scores(groups: DataFrame, orders: list[Order], single: Single, tokens: int, distinct: int, name: str) -> DataFrame:
    """The rows of the result, from a group's ``docs`` row and its answers to ``words`` and to the grams of all orders."""
    floor = tokens + 0.5 * (distinct + 1)
    names = [name, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(key: tuple, part: pa.Table) -> pa.Table:
        group = Group(part.to_pylist(), orders, single)
        return pa.Table.from_arrays([
            pa.array(group.ids, mask=~group.known), pa.array(group.held), pa.array(group.lengths),
            pa.array(group.per_document((group.counts > 0).astype(np.int64)[group.flat])), pa.array(np.full(len(group.ids), tokens, np.int64)),
            pa.array(group.per_document(np.log10((group.counts + 0.5) / floor)[group.flat])), pa.array(group.per_document(np.log10(group.chance))),
        ], names)

    schema = f"`{name}` bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return groups.groupBy("grp").applyInArrow(score, schema)


def answered_order(answers: DataFrame, order: Order, most: int) -> Order:
    """``order`` with what the shards answered: what its counts are worth, and the sums of its common contexts."""
    sums: dict[int, list] = {int(h): [np.zeros(most, np.int64), 0, 0.0] for h in order.hot}
    for r in answers.where("kind = 'hot'").select("a", "b", "c", "d").toLocalIterator():  # a row per shard
        parts = unpack(r["a"], np.uint64), unpack(r["b"], np.uint32).reshape(-1, most), unpack(r["c"], np.int64), unpack(r["d"], np.float64)
        for context, rare, whole, share in zip(*parts, strict=True):
            now = sums[int(context)]
            now[0], now[1], now[2] = now[0] + rare, now[1] + int(whole), now[2] + float(share)
    rare, whole, share = zip(*(sums[int(h)] for h in order.hot), strict=True)
    worth = discounts(sum(_summed(answers, "seen", np.int64), np.zeros(most + 2, np.int64)), most)
    return replace(order, worth=worth, rare=np.stack(rare), whole=np.array(whole, np.int64), share=np.array(share))


def _summed(rows: DataFrame, kind: str, of) -> list[np.ndarray]:
    return [unpack(r["a"], of) for r in rows.where(F.col("kind") == kind).select("a").collect()]


def katz_scores(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: KatzRule = KatzRule()) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Texts are lowered (A-Z) and cut at white space; an end token follows the last word. Rows whose
    crc32(id) modulo ``folds`` is ``held_out_fold`` are not learned from; rows without an id are. Null
    and empty texts are an end alone. ``base_score`` adds one half to every count of single tokens.
    Rows that repeat are learned from and scored as often as they come. Without training rows every
    token is unseen and every score 0; a table without rows gives none.

    To the driver come sums over counts, a few numbers per shard, and at most HOT_SHARE common contexts of each order.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    (name,) = fresh(["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], id)
    word_shards = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    groups = stored(numbered_groups(docs, id, text, word_shards, rule), "kind", free=True)
    own, asked = groups.where("kind = 'docs'"), groups.where("kind = 'words'")
    tokens = own.agg(F.sum("n")).first()[0] or 0
    words = stored(word_answers(asked, word_shards, tokens // HOT_SHARE, rule), "kind", free=True)
    most = rule.discounted
    seen = sum(_summed(words, "seen", np.int64), np.zeros(most + 2, np.int64))
    distinct = words.where("kind = 'seen'").agg(F.sum("n")).first()[0] or 0
    single = Single(tokens, seen, most) if tokens else Single(0, np.zeros(most + 2, np.int64), most)
    sized = groups.groupBy("kind").agg(F.sum("n").alias("n")).where("kind in ('words', 'size')").collect()
    rows = {r["kind"]: r["n"] for r in sized}
    known = own.unionByName(words.where("kind = 'answer'")).select(*NAMES)
    common, start, worth, orders = _summed(words, "hot", np.uint64), np.array([START], np.uint64), single.worth, []
    for k in range(2, rule.order + 1):
        # A group has at most as many grams as tokens; of pairs there are some three to a word.
        expected = 3 * rows.get("words", 0) if k == 2 else rows.get("size", 0)
        order = Order(max(4, -(-expected // rule.shard_rows)), np.unique(np.concatenate([start, *common])))
        answers = None
        for turn in range(rule.passes):
            shards = range(turn, order.shards, rule.passes)
            asked = grams_of_groups(known, [*orders, order], single, shards)
            more = stored(gram_answers(asked, k, order.hot, tokens // HOT_SHARE, worth, rule), "kind", free=True)
            answers = answers.unionByName(more) if answers else more
        orders.append(answered_order(answers, order, most))
        worth, common, start = orders[-1].worth, _summed(answers, "often", np.uint64), longer_keys(start, np.array([START], np.uint64))
        known = known.unionByName(answers.where(f"kind = 'counts{k}'").select(*NAMES))
    return group_scores(known, orders, single, tokens, distinct, name)

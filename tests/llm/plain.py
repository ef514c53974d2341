"""The operators' contracts, stated plainly for small tables held in memory."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def smallest(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def repeats(texts: list[bytes], length: int) -> list[tuple]:
    times = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if times[t[i:i + length]] > 1:
                gone[i:i + length] = 1
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def fingerprint(text: str) -> int:
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(docs: dict[int, str]) -> dict[int, tuple]:
    prints = {d: fingerprint(t or "") for d, t in docs.items()}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    groups = smallest(ids, links)
    return {d: (f"{prints[d]:016x}", groups[d]) for d in ids}


def near_copies(vectors: dict[int, tuple]) -> dict[int, tuple]:
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, float) / np.linalg.norm(np.array(v, float))

    units = {k: unit(v) for k, (v, label) in vectors.items() if label is not None}
    ids = sorted(vectors)
    links = [
        (a, b) for a in ids for b in ids
        if a < b and vectors[a][1] == vectors[b][1] and units.get(a) is not None and units.get(b) is not None and units[a] @ units[b] >= 0.98
    ]
    count = Counter(x for pair in links for x in pair)
    groups = smallest(ids, links)
    return {k: (count[k], groups[k], groups[k] == k) for k in ids}


def targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """``sizes`` by source; None is the last one."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    rest, free, out = sum(sizes.values()), set(names), {}
    while True:
        share = sum(weight[n] for n in free)
        over = [n for n in free if rest * weight[n] / share > most * sizes[n]]
        if not over:
            return out | {n: rest * weight[n] / share for n in free}
        for n in over:
            out[n] = most * sizes[n]
            free.discard(n)
        rest -= sum(out[n] for n in over)


def dedup_lines(docs: dict[int, str]) -> dict[int, tuple]:
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(LOWER)

    holders = defaultdict(set)
    for d, t in docs.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in holders or min(holders[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(stay), sha("\n".join(stay).encode()))
    return out


def measures(text: str) -> tuple:
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
    )


def katz(docs: dict[int, str], most: int = 5) -> dict[int, tuple]:
    tokens = {d: WORD.findall((t or "").translate(LOWER)) + [" end"] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    alone, pairs = Counter(), Counter()
    for d, w in tokens.items():
        if not held[d]:
            alone.update(w)
            pairs.update(zip([" start", *w], w))
    total = sum(alone.values())

    def worth(counts):
        n = Counter(counts.values())
        part = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        common = (most + 1) * n[most + 1] / n[1] if n[1] else 1.0
        out = [0.0]
        for r in range(1, most + 1):
            turing = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
            better = r * (turing / r - common) / (1 - common) if common < 1 else 0.0
            out.append(better if 0 < better < r else r - part)
        return out

    one, two = worth(alone), worth(pairs)
    lost = sum(c - one[c] for c in alone.values() if c <= most)
    whole = total if lost > 0 else total + 1
    unseen = (lost / total if lost > 0 else 1 / whole) if total else 1.0

    def single(w):
        c = alone[w]
        return unseen if not c else (one[c] if c <= most else c) / whole

    after = defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c

    def pair(h, w):
        seen = after.get(h)
        if not seen:
            return single(w)
        lost = sum(c - two[c] for c in seen.values() if c <= most)
        all_ = sum(seen.values()) + (0 if lost > 0 else 1)
        c = seen.get(w, 0)
        if c:
            return (two[c] if c <= most else c) / all_
        return (lost if lost > 0 else 1) / all_ / (1 - sum(map(single, seen))) * single(w)

    for h in list(after)[:20]:  # each context sums to one over all words and the unseen one
        assert abs(sum(pair(h, w) for w in alone) + pair(h, " never") - 1) < 1e-9
    floor = total + 0.5 * (len(alone) + 1)
    return {
        d: (
            held[d], len(w), sum(alone[x] > 0 for x in w), total, sum(math.log10((alone[x] + 0.5) / floor) for x in w),
            sum(math.log10(pair(h, x)) for h, x in zip([" start", *w], w)),
        )
        for d, w in tokens.items()
    }


def _hash(texts) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _levels(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_hash(levels[-1][k:k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def _siblings(levels: list[list[str]], place: int) -> list[tuple[list[str], list[str]]]:
    found = []
    for nodes in levels[:-1]:
        first = place // 8 * 8
        found.append((nodes[first:place], nodes[place + 1:first + 8]))
        place //= 8
    return found


def manifest(rows: list[tuple]) -> dict:
    """doc_id: leaf, subroot, root, proof, folded root, verified; rows are (doc_id, text, lang, source, n_chars)."""
    def leaf(doc_id, text, lang, source, n_chars):
        return _hash("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text))

    by_lang = defaultdict(list)
    for row in sorted(rows, key=lambda r: r[0]):
        by_lang[row[2]].append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: _levels([leaf(*row) for row in by_lang[lang]]) for lang in langs}
    top = _levels([trees[lang][-1][0] for lang in langs])
    found = {}
    for number, lang in enumerate(langs):
        for place, row in enumerate(by_lang[lang]):
            way = _siblings(trees[lang], place) + _siblings(top, number)
            text = row[1].translate(LOWER) if row[1] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 else row[1]
            folded = leaf(row[0], text, *row[2:])
            for left, right in way:
                folded = _hash([*left, folded, *right])
            root, subroot = top[-1][0], trees[lang][-1][0]
            proof = _hash(x for left, right in way for x in (*left, *right))
            found[row[0]] = (trees[lang][0][place], subroot, root, proof, folded, folded == root)
    return found


def trie(paths: dict[int, list[tuple]]) -> set[tuple]:
    """All nodes of the paths: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    members = defaultdict(list)
    for conv in sorted(paths):
        for depth in range(len(paths[conv]) + 1):
            members[tuple(paths[conv][:depth])].append(conv)
    children, leaves, saved = Counter(node[:-1] for node in members if node), Counter(), Counter()
    for node, convs in members.items():
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += not children[node]
            saved[node[:depth]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    return {
        (convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), children[node], leaves[node], saved[node],
         sha(",".join(str(c) for c in convs if len(paths[c]) == len(node)).encode()))
        for node, convs in members.items()
    }


def rebuilt(rows: list[tuple]) -> dict[int, list[tuple]]:
    """Rows of (conv_id, turn, role, text) as paths, heads exchanged."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[:h] + own[c][h:] for c, h in heads.items()}

"""Mined url rules against a brute-force miner, and texts of some megabytes."""

from __future__ import annotations

import random
import re
import sys
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402
from tugboard.llm import bpe_codec, embedding_dedup, line_dedup, mixing, quality_rules, queries, simhash_dedup, token_output, url_filters  # noqa: E402

BYTE_BPE, WORD_BPE = f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/word_bpe_49k.json"


def tokens_of(url):
    host, path = re.match(r"^.*?://([^/?#]*)([^?#]*)", url).groups()
    found = {("host", x) for x in re.findall(r"[a-z0-9]+", host.lower())} | {("path", x) for x in re.findall(r"[a-z0-9]+", path.lower())}
    return frozenset(f"{kind} {word}" for kind, word in found if not word.isdigit())


def blocked_by_brute_force(pages, labelled, rule):
    """Every combination of tokens that a bad page has, counted over all labelled pages."""
    rows = [(tokens_of(pages[p]), bad) for p, bad in labelled]
    least = max(rule.least_support, rule.least_pages / len(rows)) * len(rows)
    seen = {c for tokens, bad in rows if bad for size in range(1, len(tokens) + 1) for c in combinations(sorted(tokens), size)}
    rules = []
    for chosen in seen:
        marks = [bad for tokens, bad in rows if tokens.issuperset(chosen)]
        if sum(marks) >= least - 1e-9 and sum(marks) / len(marks) >= rule.least_confidence:
            rules.append(frozenset(chosen))
    return {p for p, url in pages.items() if any(r <= tokens_of(url) for r in rules)}, rules


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_rules(spark, seed):
    rng = random.Random(seed)
    words = ["buy", "spam", "read", "en", "cheap", "News"]
    pages = {k: f"http://{rng.choice(['shop', 'blog', 'Www'])}.{rng.choice(words[:3])}.net/{'/'.join(rng.sample(words, rng.randrange(4)))}/{k}" for k in range(260)}
    labelled = []
    for page, url in pages.items():
        if page % 4:   # the others carry no label
            odds = 0.9 if {"path buy", "path cheap"} <= tokens_of(url) else 0.75 if "host spam" in tokens_of(url) else 0.2
            labelled.append((page, rng.random() < odds))
    rule = url_filters.MiningRule(least_support=0.02, least_pages=6, least_confidence=0.7)
    expected, rules = blocked_by_brute_force(pages, labelled, rule)
    assert len(rules) > 2 and 10 < len(expected) < 250
    frame = spark.createDataFrame(list(pages.items()), "page_id long, url string").repartition(3)
    labels = spark.createDataFrame([(p, int(not bad), None) for p, bad in labelled], "doc_id long, quality int, toxic int")
    found = url_filters.filter_urls(frame, labels, [], rule=rule)
    assert {r.page_id for r in found.where("verdict = 'block'").collect()} == expected


def test_pages_without_ids_and_repeated_pages(spark):
    rows = [(None, "http://a.org/es/1", "x", 1)] * 2 + [(5, "http://a.org/es/1", "x", 1)] * 2 + [(6, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, mined long")
    labels = spark.createDataFrame([(5, 0, 1), (5, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = sorted((tuple(r) for r in url_filters.filter_urls(frame, labels, queries.URL_RULES).collect()), key=str)
    assert got == sorted([(p, "a.org", "/es/1", "org/", "allow") for p in (None, None, 5, 5)] + [(6, "", "", None, "allow")], key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = ["the", "Word,", "déjà", "x1", "日本", "ipsum", "It's"] + ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 12))) for _ in range(3000)]
    lines = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(12_000)]
    long = "\n".join(lines + rng.choices(lines, k=3000))
    return {0: long, 1: " ".join(lines), 2: long[:5000], 3: "a" * 1_500_000, 4: "", 5: None}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", "s", None) for k, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def test_long_texts(docs, texts, tmp_path):
    assert max(len(t or "") for t in texts.values()) > 1_200_000
    lines = line_dedup.drop_repeated_lines(docs).withColumn("kept", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in lines.collect()} == plain.dedup_lines(texts)
    measured = {r.doc_id: tuple(r[m] for m in quality_rules.MEASURES) for r in quality_rules.quality_rules(docs).collect()}
    assert measured == {d: plain.measures(t) for d, t in texts.items()}
    prints = {r.doc_id: int(r.fingerprint, 16) for r in simhash_dedup.simhash_groups(docs).collect()}
    assert prints == {d: plain.fingerprint(t or "") for d, t in texts.items()}
    sizes = {r.doc_id: r.size for r in mixing.mix_counts(docs).collect()}
    assert sizes == {d: len(plain.WORD.findall(t or "")) for d, t in texts.items()}


def test_long_texts_in_tokens(spark, docs, texts, tmp_path):
    known = Tokenizer.from_file(BYTE_BPE)
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in bpe_codec.round_trip(docs, BYTE_BPE).collect()}
    ids = {d: known.encode(t or "", add_special_tokens=False).ids for d, t in texts.items()}
    assert got == {d: (len(x), plain.sha((texts[d] or "").encode())) for d, x in ids.items()}
    token_output.write_tokens(docs, str(tmp_path / "t"), token_output.TokenRule(WORD_BPE))
    known = Tokenizer.from_file(WORD_BPE)
    rows = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_output.read_tokens(spark, str(tmp_path / "t")).collect()}
    ids = {d: [*known.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    assert rows == {d: (len(x), zlib.crc32(np.array(x, "<u4"))) for d, x in ids.items()}


def test_vectors_without_an_id(spark):
    rows = [(3, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (None, [0.0, 2.0], 1), (5, [1.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = embedding_dedup.near_copies(frame).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [
        (0, 1, 0, True), (0, 1, 0, True), (0, 1, 3, False), (3, 1, 3, True), (5, 0, 5, True),
    ]

"""Hits against all shared word runs."""

import re
from collections import defaultdict

import numpy as np
import pytest

from strideway.llm import common, winnowing

LEAST = winnowing.GRAM + winnowing.WINDOW - 1


def spans(docs, items):
    """The longest shared run of every pair of texts that share ``LEAST`` words."""
    own = {k: re.findall(r"[\w\x80-\U0010ffff]+", t.lower()) for k, t in items.items()}
    grams = defaultdict(set)
    for k, w in own.items():
        for j in range(len(w) - LEAST + 1):
            grams[tuple(w[j : j + LEAST])].add((k, j))
    best: dict = {}
    for d, text in docs.items():
        w = re.findall(r"[\w\x80-\U0010ffff]+", text.lower())
        for i in range(len(w) - LEAST + 1):
            for k, j in grams.get(tuple(w[i : i + LEAST]), ()):
                n = 0
                while i + n < len(w) and j + n < len(own[k]) and w[i + n] == own[k][j + n]:
                    n += 1
                best[d, k] = max(best.get((d, k), 0), n)
    return best


@pytest.mark.parametrize("limit", [winnowing.SEND_LIMIT, 0])
def test_against_all_runs(spark, data, limit):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    want = spans({r.doc_id: r.text for r in docs.collect() if r.text}, {r.item_id: r.text for r in bench.collect() if r.text})
    got = {(r.doc_id, r.item_id): r.span_words for r in winnowing.hits(docs, bench, limit).collect()}
    assert want and got == want


def test_longest_run_against_all_runs():
    rng = np.random.default_rng(8)
    for _ in range(400):
        a, b = (rng.integers(0, 3, rng.integers(0, 40)).astype(np.uint64) for _ in "ab")
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= 4 and n > best[0]:
                    best = (n, i, j)
        assert winnowing.longest_run(a, b, 4) == best


def test_repetitive_texts(spark):
    """Pairs of texts that share one fingerprint at very many places are compared once."""
    docs = spark.createDataFrame([(1, "again and " * 60_000 + "end")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "start " + "again and " * 5000)], "item_id bigint, text string")
    assert [tuple(r) for r in winnowing.hits(docs, bench).collect()] == [(1, 1, 0, 1, 10_000, 10_001)]


def test_guarantee():
    rng = np.random.default_rng(5)
    shared = [f"s{i}" for i in range(LEAST)]
    for _ in range(200):
        a = [*(f"a{x}" for x in rng.integers(0, 9, rng.integers(0, 40))), *shared, *(f"b{x}" for x in rng.integers(0, 9, 20))]
        b = [*(f"c{x}" for x in rng.integers(0, 9, rng.integers(0, 40))), *shared]
        x, y = (set(winnowing.winnow(*common.word_hashes([" ".join(t)]))[2].tolist()) for t in (a, b))
        assert x & y


def test_clean_documents_stay(spark, data):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    hit = {r.doc_id for r in winnowing.hits(docs, bench).collect()}
    kept = {r.doc_id for r in winnowing.decontaminate(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - hit

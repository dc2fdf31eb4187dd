"""Code lengths against the recursive definition on a small corpus, by both ways of scoring."""

import math

import pytest
from pyspark.sql import functions as F

from strideway.llm import context_tree

DEPTH = 3


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def brute(train: list[str], text: str) -> float:
    counts: dict = {}

    def each(t):
        b = bytes(DEPTH) + t.encode()
        for i in range(DEPTH, len(b)):
            past = b[i - DEPTH : i][::-1]
            for k in range(8):
                yield past, (1 << k) | b[i] >> (8 - k), b[i] >> (7 - k) & 1

    for t in train:
        for past, decision, bit in each(t):
            for d in range(DEPTH + 1):
                counts.setdefault((past[:d], decision), [0, 0])[bit] += 1
    children: dict = {}
    for past, decision in counts:
        if past:
            children.setdefault((past[:-1], decision), []).append((past, decision))
    memo: dict = {}

    def weighted(node):
        if node not in memo:
            own = kt(*counts[node])
            if len(node[0]) == DEPTH:
                memo[node] = own
            else:
                below = sum(weighted(c) for c in children[node])
                hi = max(own, below)
                memo[node] = hi + math.log(math.exp(own - hi) + math.exp(below - hi)) + math.log(0.5)
        return memo[node]

    bits = 0.0
    for past, decision, bit in each(text):
        mixed, left = 0.0, 1.0
        for d in range(DEPTH + 1):
            node = (past[:d], decision)
            a, b = counts.get(node, (0, 0))
            if d == DEPTH:
                own = 1.0
            else:
                own = math.exp(min(kt(a, b) + math.log(0.5) - weighted(node), 0.0)) if node in counts else (0.5 if d < 0 else 1.0)
            mixed, left = mixed + left * own * (b + 0.5) / (a + b + 1), left * (1 - own)
        bits -= math.log2(mixed if bit else 1 - mixed)
    return bits


@pytest.mark.parametrize("limit", [10**6, 0])
def test_against_the_definition(spark, limit):
    texts = ["abracadabra", "abracadabra abracadabra", "the cat sat on the mat", "the dog sat on the log", "é à é à", "aaaaaaaaaaaaaaaa",
        "", "cadabra"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    side = {r.doc_id: r.half for r in df.select("doc_id", context_tree.half(df)).collect()}
    assert set(side.values()) == {0, 1}
    out = context_tree.code_lengths(df, DEPTH, limit).collect()
    assert len(out) == len(texts)
    for r in out:
        others = [t for i, t in enumerate(texts) if side[i] != side[r.doc_id]]
        assert r.bits == pytest.approx(brute(others, texts[r.doc_id]), rel=1e-4, abs=1e-3)
        assert r.n_bytes == len(texts[r.doc_id].encode())


def test_language_scores_below_noise(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    noise = "".join(chr(33 + (i * i * 31 + i * 7919) % 94) for i in range(3000))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, noise)], "doc_id bigint, text string"))
    out = {r.doc_id: r.bits_per_byte for r in context_tree.code_lengths(both).collect()}
    usual = sorted(v for k, v in out.items() if k >= 0 and v is not None)
    assert usual[len(usual) // 2] < 3.5 < 6 < out[-1]


def test_counts_follow_the_corpus(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = lambda d: context_tree.gather(d).agg(F.sum(F.col("n0") + F.col("n1"))).first()[0]
    assert n(docs) == docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert n(docs.unionByName(docs)) == 2 * n(docs)

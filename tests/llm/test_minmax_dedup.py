"""Signatures against Jaccard similarity, groups against all comparisons."""

import re
from collections import defaultdict

import numpy as np
import pytest

from strideway.llm import minmax_dedup


def shingles(text):
    w = re.findall(r"[\w\x80-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        other = [w if rng.random() > 0.05 else "new" + w for w in base]
        a, b = " ".join(base), " ".join(other)
        sig = minmax_dedup.signatures([a, b])
        x, y = shingles(a), shingles(b)
        errors.append((sig[0] == sig[1]).mean() - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_groups_against_all_pairs(spark, data):
    docs = spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect() if r.text is not None}
    by = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by[g].append(d)
    pairs = {(min(a, b), max(a, b)) for v in by.values() for a in v for b in v if a != b}
    sim = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    near = [p for p, s in sim.items() if s >= minmax_dedup.THRESHOLD + 0.05]
    group = {r.doc_id: r.group_id for r in minmax_dedup.groups(docs).collect()}
    found = sum(1 for a, b in near if a in group and group[a] == group.get(b))
    assert len(near) > 50 and found >= 0.95 * len(near)
    members = defaultdict(list)
    for d, g in group.items():
        members[g].append(d)
    for g, own in members.items():
        assert g == min(own) and len(own) > 1
        for d in own:  # each is near another of its group
            assert any(len(sets[d] & sets[o]) / len(sets[d] | sets[o]) >= minmax_dedup.THRESHOLD - 0.15 for o in own if o != d)
    kept = {r.doc_id for r in minmax_dedup.keep_one(docs).collect()}
    assert kept == {d for d in sets if group.get(d, d) == d} | {r.doc_id for r in docs.where("text IS NULL").collect()}


def test_bucket_joins_what_all_pairs_would():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**16, (5, 128)).astype(np.uint16)
    sig = base[rng.integers(0, 5, 60)].copy()
    noise = rng.random(sig.shape) < 0.3
    sig[noise] = rng.integers(0, 2**16, noise.sum())
    root = list(range(60))
    find = lambda i: i if root[i] == i else find(root[i])

    def closed(edges):
        root[:] = range(60)
        for i, j in edges:
            root[find(i)] = find(j)
        return [find(i) for i in range(60)]

    all_pairs = closed([(i, j) for i in range(60) for j in range(i) if (sig[i] == sig[j]).mean() >= 0.45])
    forest = closed(minmax_dedup.forest(sig, 0.45))
    assert [[a == b for b in all_pairs] for a in all_pairs] == [[a == b for b in forest] for a in forest]


@pytest.mark.parametrize("n", [2, 3, 400])
def test_components_of_chains(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 10 + n)], "a bigint, b bigint")
    assert {(r.node, r.label) for r in minmax_dedup.components(edges).collect()} == {(i, 10) for i in range(10, 11 + n)}

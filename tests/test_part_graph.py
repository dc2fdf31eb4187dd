"""The graph of parts against brute force, on a table beyond the least modulus, in one task and by rounds."""

from collections import deque

import pytest

from strideway.operators import graph
from strideway.plans import catalog

PARTS = 3000


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("parts"))
    spark.range(PARTS).withColumnRenamed("id", "p_partkey").write.parquet(f"{d}/part.parquet")
    return d


def hops(roots):
    out = {r: 0 for r in roots}
    work = deque(roots)
    while work:
        n = work.popleft()
        for m in ((7 * n + 3) % PARTS, n // 2):
            if m not in out:
                out[m] = out[n] + 1
                work.append(m)
    return out


@pytest.mark.parametrize("hops_", [graph.HOPS, 1])
def test_all_parts_are_nodes(spark, parts, monkeypatch, hops_):
    monkeypatch.setattr(graph, "HOPS", hops_)
    a, b = hops(range(5)), hops(range(100, 105))
    want = {n: (n in a) + 2 * (n in b) for n in a.keys() | b.keys()}
    assert {r.node: r.mask for r in catalog.reachability(spark, parts).collect()} == want


def test_steps_of_all_parts(spark, parts):
    want = {n: k for n, k in hops(range(5)).items() if k <= 5}
    assert {r.node: r.hops for r in catalog.bounded_reachability(spark, parts).collect()} == want

"""Pairs against all comparisons."""

import numpy as np
import pytest

from strideway.llm import cover_tree


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 16))
    return np.concatenate([x, x[:80] + 0.05 * rng.normal(size=(80, 16)), np.repeat(x[5:6], 30, axis=0), 4 * x[7:8]]).astype(np.float32)


def brute(ids, x, threshold):
    """{id: (least id of its class, other ids linked)} by comparing all pairs."""
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = {i: {i} for i in ids}
    for i, j in zip(*np.nonzero(y @ y.T >= threshold)):
        near[ids[i]].add(ids[j])
    label = dict.fromkeys(near)
    for start in sorted(near):
        todo = [start] if label[start] is None else []
        while todo:
            i = todo.pop()
            if label[i] is None:
                label[i] = start
                todo += near[i]
    return {i: (label[i], len(near[i]) - 1) for i in near}


@pytest.mark.parametrize("threshold", [0.95, 0.6])
@pytest.mark.parametrize("block", [4096, 41])
def test_classes(spark, vectors, threshold, block):
    ids = [*range(len(vectors) - 2), 3, 200]  # two ids with two vectors each
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: (r.class_id, r.links) for r in cover_tree.classes(df, threshold, block).collect()}
    assert got == brute(ids, vectors, threshold)


def test_tight_class(spark):
    """A third of all rows within a small radius is counted without comparing its pairs."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    x[:200] = x[0] + 0.01 * rng.normal(size=(200, 16))
    x[200:260] = x[0] + 0.3 * rng.normal(size=(60, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    for block in (4096, 50):
        got = {r.vec_id: (r.class_id, r.links) for r in cover_tree.classes(df, 0.95, block).collect()}
        assert got == brute(list(range(600)), x, 0.95)
    t = cover_tree.Tree(cover_tree.unit(x[:200]))
    i, j, whole = cover_tree.dual(t, t, float(np.sqrt(0.1)))
    assert len(i) == 0 and ((whole[:, 1] - whole[:, 0]) * (whole[:, 3] - whole[:, 2])).sum() == 200 * 200


def test_numbers_beyond_single_precision(spark):
    rows = [(1, [1e300, 0.0]), (2, [1e-300, 0.0]), (3, [0.0, 1e200])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, cover_tree.classes(df).collect())) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_tree_is_nested(vectors):
    t = cover_tree.Tree(cover_tree.unit(vectors))
    for k, m in enumerate(t.sizes):
        d = cover_tree.apart(t.x, t.x[t.order[:m]])
        assert (d[np.arange(len(t.x)), t.up[k]] <= t.radius[k][t.up[k]] + 1e-3).all()
        if k:
            assert t.sizes[k - 1] <= m
            assert (t.up[k - 1] == t.up[k - 1][t.order[t.up[k]]]).all()
            assert (t.hi[k - 1] - t.lo[k - 1]).sum() == len(t.x)
        for i in range(m):
            assert (t.up[k][t.lo[k][i] : t.hi[k][i]] == i).all()
    every = np.concatenate([t.children(len(t.sizes) - 1, np.arange(t.sizes[-1]))])
    assert sorted(every) == list(range(len(vectors)))

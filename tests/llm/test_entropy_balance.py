"""Constraints met, the tilt exponential, the optimum that of a direct search, copies unbiased."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from strideway.llm import entropy_balance


@pytest.fixture(scope="module")
def rated(spark, data):
    docs = spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    return docs, entropy_balance.rates(docs).toPandas()


def test_constraints(rated):
    _, r = rated
    for key in ("source", "lang"):
        own = r.groupby(key, dropna=False).tokens.sum()
        want = entropy_balance.targets(own.to_numpy(float))
        got = (r.tokens * r.rate).groupby(r[key], dropna=False).sum().to_numpy()
        assert got == pytest.approx(want, rel=1e-5)
    z = np.log(np.maximum(r.tokens, 1))
    assert (r.tokens * r.rate * z).sum() / (r.tokens * r.rate).sum() == pytest.approx((r.tokens * z).sum() / r.tokens.sum(), rel=1e-6)


def test_no_rates_are_nearer(rated):
    """Moves that keep all constraints only raise the divergence."""
    _, r = rated
    n, rate = r.tokens.to_numpy(float), r.rate.to_numpy()
    z = np.log(np.maximum(n, 1))
    cats = [(r[k] == v).to_numpy(float) for k in ("source", "lang") for v in r[k].unique()]
    a = np.stack([n * c for c in cats] + [n * z])
    rng = np.random.default_rng(0)
    cost = lambda x: (n * (x * np.log(x) - x + 1)).sum()
    for _ in range(20):
        d = rng.normal(size=len(n))
        d -= np.linalg.lstsq(a, a @ d, rcond=None)[0]
        for e in (1e-4, -1e-4):
            x = rate + e * d
            assert (x > 0).all() and cost(x) >= cost(rate) - 1e-6


def test_against_a_second_solver(rated):
    """Multipliers found one at a time, each by its own constraint, give the same rates."""
    _, r = rated
    n = r.tokens.to_numpy(float)
    there = n > 0
    r, n = r[there], n[there]
    z = np.log(n)
    z = z - (n * z).sum() / n.sum()
    kinds = [r[k].astype(object).where(r[k].notna(), "none").to_numpy() for k in ("source", "lang")]
    places = [np.unique(k, return_inverse=True)[1] for k in kinds]
    goals = [entropy_balance.targets(np.bincount(p, n)) for p in places]
    theta, c = [np.zeros(len(g)) for g in goals], 0.0
    for _ in range(400):
        for k, p in enumerate(places):
            rate = np.exp(theta[0][places[0]] + theta[1][places[1]] + c * z)
            theta[k] += np.log(goals[k] / np.bincount(p, n * rate))
        base = n * np.exp(theta[0][places[0]] + theta[1][places[1]])
        low, high = c - 2, c + 2
        for _ in range(60):  # the mean of z rises with c
            c = (low + high) / 2
            low, high = (c, high) if (base * np.exp(c * z) * z).sum() < 0 else (low, c)
    rate = np.exp(theta[0][places[0]] + theta[1][places[1]] + c * z)
    assert rate == pytest.approx(r.rate.to_numpy(), rel=1e-4)


def test_copies(rated):
    docs, r = rated
    assert ((r.copies == np.floor(r.rate)) | (r.copies == np.floor(r.rate) + 1)).all()
    assert r.copies.sum() == pytest.approx(r.rate.sum(), rel=0.06)
    n = Counter(x.doc_id for x in entropy_balance.mix(docs).select("doc_id").collect())
    assert all(n[d] == c for d, c in zip(r.doc_id, r.copies))


def test_given_weights(spark):
    rows = [(i, "a b c d"[: 1 + 2 * (i // 4 % 4)], "xy"[i % 2], "uv"[i // 2 % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    out = entropy_balance.rates(docs, source_weights={"x": 3.0, "y": 1.0}, lang_weights={"u": 1.0, "v": 1.0}).collect()
    got: dict = defaultdict(float)
    for r in out:
        got[r.source] += r.tokens * r.rate
    assert got["x"] / got["y"] == pytest.approx(3.0, rel=1e-4)


def test_what_cannot_be_met_is_relaxed(spark):
    rows = [(1, "a b c", "x", "u"), (2, "d e f", "y", "v"), (3, "g h i", "y", "v")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    out = entropy_balance.rates(docs, source_weights={"x": 9.0, "y": 1.0}, lang_weights={"u": 1.0, "v": 9.0}).collect()
    assert all(0 < r.rate < np.exp(entropy_balance.LARGEST) for r in out)

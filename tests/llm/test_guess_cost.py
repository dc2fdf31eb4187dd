"""The cheapest segmentation against all segmentations of short values."""

import math
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strideway.llm import guess_cost


def brute(value: str) -> float:
    auto, char = guess_cost.dictionary(), math.log10(guess_cost.alphabet(value))

    @cache
    def least(text: str) -> float:
        spans: dict = {}
        of_unit = lambda u: len(u) * char if u == text else least(u)
        for found in (guess_cost.words(text, auto), guess_cost.dates(text), guess_cost.walks(text), guess_cost.repeats(text, of_unit)):
            for s, e, c in found:
                spans[s, e] = min(c, spans.get((s, e), math.inf))
        best = math.inf
        n = len(text)
        for cuts in range(1 << (n - 1)):
            at = [0, *(i for i in range(1, n) if cuts >> (i - 1) & 1), n]
            cost = sum(min(spans.get((a, b), math.inf), (b - a) * char) for a, b in zip(at, at[1:]))
            best = min(best, cost + (len(at) - 2) * guess_cost.JOIN)
        return best

    return least(value)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aAsSdqw12p@0o9-/", min_size=1, max_size=9))
def test_against_all_segmentations(value):
    cost, parts = guess_cost.cheapest(value, guess_cost.dictionary())
    assert cost == pytest.approx(brute(value), abs=1e-9)
    assert [p[1] for p in parts] == [0, *(p[2] for p in parts[:-1])] and parts[-1][2] == len(value)


@pytest.mark.parametrize(
    ("value", "kinds"),
    [("password", ["word"]), ("P@ssw0rd", ["word"]), ("qwertyuiop", ["walk"]), ("19840512", ["date"]), ("zkzkzkzk", ["repeat"]),
        ("8f3a9c", ["guess"])],
)
def test_kinds(value, kinds):
    assert [p[0] for p in guess_cost.cheapest(value, guess_cost.dictionary())[1]] == kinds


def test_contexts():
    text = 'my password=abc, "api_key": "x y" token := \'q\' Authorization: Bearer zzz pass: compass north'
    assert [(k, v) for _, k, v in guess_cost.values(text)] == [("password", "abc"), ("api_key", "x y"), ("token", "q"),
        ("authorization", "zzz"), ("pass", "compass")]
    assert all(text[p : p + len(v)] == v for p, _, v in guess_cost.values(text))


def test_secrets_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = guess_cost.scan(docs).collect()
    naive = sum(len(list(guess_cost.values(r.text))) for r in docs.collect() if r.text)
    assert len(out) == naive
    assert all(r.secret == (r.log10_guesses >= guess_cost.THRESHOLD) for r in out)


def test_long_units():
    import random

    unit = "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=90))
    auto = guess_cost.dictionary()
    cost, parts = guess_cost.cheapest(unit * 3, auto)
    assert parts == [("repeat", 0, 270)] and cost == pytest.approx(guess_cost.cheapest(unit, auto, char=math.log10(36))[0] + math.log10(3))


def test_long_values_end():
    auto = guess_cost.dictionary()
    assert guess_cost.cheapest("ab12" * 5000, auto)[1] == [("repeat", 0, 20000)]
    assert guess_cost.cheapest("q" * 20000, auto)[0] < 10

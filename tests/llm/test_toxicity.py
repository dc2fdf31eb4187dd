"""Folding, exceptions and length, and accuracy on labelled rows that nothing was learned from."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strideway.llm import toxicity


@pytest.fixture(scope="module")
def match():
    return toxicity.Matcher(toxicity.LEXICON)


@pytest.mark.parametrize("text", ["You IDIOT", "1d10t", "іdіоt", "i​d​iot", "ídïòt", "$tup1d", "ＩＤＩＯＴ", "piece   of\nshit"])
def test_disguises(match, text):
    assert match([text])[1][0] == 1


@pytest.mark.parametrize("text", ["idiot-proof and idiot proof", "the trash can", "guinea pig", "a clown fish", "assess the classic",
        "piglet", ""])
def test_what_is_left_alone(match, text):
    hits = match([text])[1][0]
    assert hits == (1 if text.startswith("idiot-proof") and toxicity.folded("idiot-proof") != toxicity.folded("idiot proof") else 0)


def naive(text, terms, exceptions):
    """(words, hits, weight) of one text by trying every term at every place."""
    folded = toxicity.folded(text)
    found = []
    for t, w in {**terms, **dict.fromkeys(exceptions, 0.0)}.items():
        for i in range(len(folded)):
            j = i + len(t)
            if folded.startswith(t, i) and not folded[i - 1 : i].isalnum() and not folded[j : j + 1].isalnum():
                found.append((i, j, w))
    safe = [x for x in found if not x[2]]
    left = [x for x in found if x[2] and not any(s[0] <= x[0] and s[1] >= x[1] for s in safe)]
    taken: list = []
    for x in sorted(left, key=lambda x: (-x[2], x[0] - x[1], x[0])):
        if all(x[1] <= y[0] or x[0] >= y[1] for y in taken):
            taken.append(x)
    return len(folded.split()), len(taken), sum(x[2] for x in taken)


PARTS = ["pig", "farm", "in", "the", "west", "country", "trash", "can", "idiot", "piece", "of", "shit", "bullshit", "x"]
TERMS = {"pig": 1.0, "trash": 2.0, "idiot": 3.0, "piece of shit": 4.0, "shit": 3.0, "of": 0.5, "country": 0.5}
SAFE = ["pig farm in the west country", "trash can", "in", "the", "west", "farm", "of shit x", "shit x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_matcher_against_brute_force(words):
    text = " ".join(words)
    n, hits, weight = toxicity.Matcher(TERMS, exceptions=SAFE)([text])
    assert (n[0], hits[0], weight[0]) == naive(text, TERMS, SAFE)


def test_overlaps_count_once_and_length_normalises(match):
    words, hits, weight = match(["piece of shit", "piece of shit " + "word " * 97])
    assert hits.tolist() == [1, 1] and weight.tolist() == [4.0, 4.0] and words.tolist() == [3, 100]


def test_batches_do_not_run_together(match):
    one = [match([t])[2][0] for t in ("you are a mor", "on and an idiot", "scum")]
    assert match(["you are a mor", "on and an idiot", "scum"])[2].tolist() == one


def test_held_out_labels(spark, data):
    root = data.rsplit("/", 1)[0] + "/sf0.1"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    labels = spark.read.parquet(f"{root}/labels.parquet")
    train, test = labels.where("pmod(xxhash64(doc_id), 4) <> 0"), labels.where("pmod(xxhash64(doc_id), 4) = 0")
    learned = toxicity.learn(docs, train)
    found = {r.doc_id for r in toxicity.scores(docs, learned=learned).where(f"score >= {toxicity.THRESHOLD}").collect()}
    truth = {r.doc_id: r.toxic for r in test.collect()}
    right = sum(1 for k, v in truth.items() if v and k in found)
    wrong = sum(1 for k, v in truth.items() if not v and k in found)
    assert right >= 0.85 * sum(truth.values())
    assert wrong <= 0.02 * (len(truth) - sum(truth.values()))

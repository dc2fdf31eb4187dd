"""Benchmark decontamination by winnowing.

Of the hashes of all ``GRAM``-word runs, the smallest of every ``WINDOW`` consecutive ones is kept (the rightmost of equals),
so any shared span of at least ``GRAM + WINDOW - 1`` words has a fingerprint in both texts. Fingerprints of training and test
texts are joined, and the hits of a pair of texts are extended to the longest run of equal words. A document is contaminated if a
span reaches ``GRAM + WINDOW - 1`` words.

Defined results: null texts, null ids and texts of fewer than ``GRAM`` words give no fingerprints. Case and punctuation do
not matter. Repeated rows repeat nothing: a (doc_id, item_id) pair is reported once, with its longest span; of equally long ones
the first in the document, then in the item. Very long texts are compared in whole, and repetitive ones cost no more than others.
Other columns of any name stay. Where either table is empty nothing is found and every document is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM = 6
WINDOW = 8
#: Test fingerprints up to this number are sent to all tasks; more are joined by shuffle.
SEND_LIMIT = 4_000_000
_MAX = np.uint64(2**64 - 1)


def winnow(words: np.ndarray, offsets: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, word position, hash) of the kept fingerprints. A text with fewer grams than a window keeps their minimum."""
    grams, to = common.gram_hashes(words, offsets, gram)
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    counts = np.diff(to)
    text = np.repeat(np.arange(len(counts)), counts)
    best, at = grams.copy(), np.arange(n)
    left = np.repeat(to[1:], counts) - at  # grams from here to the text's end
    for j in range(1, min(window, n)):
        there = grams[j:]
        less = (there <= best[:-j]) & (left[:-j] > j)
        best[:-j][less] = there[less]
        at[:-j][less] = np.flatnonzero(less) + j
    keep = (left >= window) | (at * 0 + np.arange(n) == np.repeat(to[:-1], counts))
    at = np.unique(at[keep])
    return text[at], at - to[text[at]], grams[at]


def _fingerprints(sent):
    @common.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if sent is None else sent.value
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i, j in common.chunks(texts):
                text, at, h = winnow(*common.word_hashes(texts[i:j]))
                if known is not None:
                    spot = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                    hit = known[spot] == h if len(known) else np.zeros(len(h), bool)
                    text, at, h = text[hit], at[hit], h[hit]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][text], pa.int64()), pa.array(at, pa.int32()),
                        pa.array(h.view(np.int64))], ["id", "at", "h"])

    return run


def fingerprints(df: DataFrame, key: str, known=None) -> DataFrame:
    """(id, at, h) of the texts' fingerprints; with ``known`` (sorted and broadcast), only of those hashes."""
    own = df.select(F.col(key).cast("bigint").alias("id"), F.col("text")).where(f"`{key}` IS NOT NULL AND text IS NOT NULL")
    return own.mapInArrow(_fingerprints(known), "id bigint, at int, h bigint")


def longest_run(a: np.ndarray, b: np.ndarray, least: int) -> tuple[int, int, int]:
    """The longest run of at least ``least`` words that a and b share: length, start in a, start in b, the first in a, then in b; 0 without one.

    A hit is extended to all sizes at once: texts that share a run of n words share one of every smaller size, so that the longest is found by
    halving. A size is tested by the hashes of all runs of that size.
    """
    if min(len(a), len(b)) < least:
        return 0, 0, 0
    both = np.concatenate([a, b])
    power, inverse = common.powers(len(both) + 1)
    upto = np.zeros(len(both) + 1, np.uint64)
    np.cumsum(common.mix(both) * power[: len(both)], out=upto[1:])
    of = lambda begin, n, size: (upto[begin + size : begin + n + 1] - upto[begin : begin + n - size + 1]) * inverse[begin : begin
        + n - size + 1]

    def shared(size: int) -> np.ndarray:
        return np.flatnonzero(np.isin(of(0, len(a), size), of(len(a), len(b), size)))

    if not len(shared(least)):
        return 0, 0, 0
    low, high = least, min(len(a), len(b)) + 1
    while high - low > 1:
        size = (low + high) // 2
        low, high = (size, high) if len(shared(size)) else (low, size)
    i = int(shared(low)[0])
    j = int(np.flatnonzero(of(len(a), len(b), low) == of(0, len(a), low)[i])[0])
    return low, i, j


def _extend(least: int):
    @common.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 64):
            rows = []
            for doc_id, item_id, text, item_text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "item_text"))):
                a, b = common.word_hashes([text])[0], common.word_hashes([item_text])[0]
                n, i, j = longest_run(a, b, least)
                if n:
                    rows.append((doc_id, item_id, i, j, n, len(b)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                ["doc_id", "item_id", "doc_word", "item_word", "span_words", "item_words"])

    return run


def hits(docs: DataFrame, benchmark: DataFrame, send_limit: int = SEND_LIMIT) -> DataFrame:
    """The longest shared span of each contaminated document and item: (doc_id, item_id, doc_word, item_word, span_words, item_words)."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"),
        F.col("text").alias("item_text")).where("item_id IS NOT NULL AND item_text IS NOT NULL")
    test = common.saved(fingerprints(benchmark, "item_id"), "items")
    known = None
    if test.count() <= send_limit:
        held = test.select("h").distinct().toArrow()["h"].to_numpy().view(np.uint64)
        known = docs.sparkSession.sparkContext.broadcast(np.sort(held))
    # a pair of texts is compared once, however many fingerprints they share
    train = fingerprints(docs, "doc_id", known).select(F.col("id").alias("doc_id"), "h").distinct()
    train = common.saved(train, "seeds") if known is not None else train
    pairs = common.saved(train.join(common.small(test.select("h", F.col("id").alias("item_id")).distinct()), "h")
        .select("doc_id", "item_id").distinct(), "pairs")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL")
    full = texts.join(common.small(pairs), "doc_id").join(common.small(common.saved(items, "item_texts")), "item_id").select("doc_id",
        "text", "item_id", "item_text")
    spans = full.mapInArrow(_extend(GRAM + WINDOW - 1),
        "doc_id bigint, item_id bigint, doc_word int, item_word int, span_words int, item_words int")
    best = F.max(F.struct("span_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"), "item_words")).alias("m")
    return spans.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("m.d")).alias("doc_word"),
        (-F.col("m.i")).alias("item_word"), "m.span_words", "m.item_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; rows with a null id or text stay."""
    found = common.saved(hits(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(common.small(found), "doc_id", "left_anti").select(*common.quoted(docs.columns))

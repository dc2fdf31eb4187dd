"""Near-duplicate documents by min-max hashing.

Each of ``PERMUTATIONS`` permutations of the shingle hashes gives two signature values, its minimum and its maximum, so a
signature of 128 values costs 64 hash evaluations. Equal values are an unbiased estimate of the Jaccard similarity.
Candidates share a band of ``ROWS`` values; a bucket's members are joined until every pair in different components has
been compared, so that no partner is capped; components are then closed over all buckets.

Defined results: a null text or null id has no signature and never groups. Texts without words form one group; a text of
fewer than ``SHINGLE`` words is one shingle. Rows that repeat an id count as one document. The kept document of a group is
the one with the smallest id. Very long texts are hashed in whole. Texts of equal similarity to several groups join them all.
Other columns of any name stay. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
THRESHOLD = 0.55
_RNG = np.random.Generator(np.random.PCG64(77))
_MULT = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_BAND_SALT = common.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_EMPTY = np.uint64(0x5EED)


def shingles(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every text and their offsets; every text has at least one."""
    words, at = common.word_hashes(texts)
    grams, to = common.gram_hashes(words, at, k)
    counts = np.diff(to)
    if counts.all():
        return grams, to
    pieces = []
    for i in range(len(texts)):
        if counts[i]:
            pieces.append(grams[to[i] : to[i + 1]])
        else:
            h = _EMPTY
            with np.errstate(over="ignore"):
                for w in words[at[i] : at[i + 1]]:
                    h = common.mix(np.array([h * np.uint64(31) + w]))[0]
            pieces.append(np.array([h], np.uint64))
    to = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=to[1:])
    return np.concatenate(pieces), to


def signatures(texts: list[str]) -> np.ndarray:
    """A row of ``2 * PERMUTATIONS`` 16-bit values for each text: minima at even, maxima at odd places."""
    grams, to = shingles(texts)
    out = np.empty((len(texts), 2 * PERMUTATIONS), np.uint16)
    h = np.empty_like(grams)
    for p in range(PERMUTATIONS):
        np.multiply(grams, _MULT[p], out=h)
        np.add(h, _ADD[p], out=h)
        # the permuted value is multiplied once more, so that its kept bits do not follow its order
        out[:, 2 * p] = (np.minimum.reduceat(h, to[:-1]) * common._BASE) >> np.uint64(48)
        out[:, 2 * p + 1] = (np.maximum.reduceat(h, to[:-1]) * common._BASE) >> np.uint64(48)
    return out


@common.trimmed
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        parts = [signatures(texts[i:j]) for i, j in common.chunks(texts)]
        if parts:
            sig = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "sig"])


@common.trimmed
def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(batch.num_rows, BANDS)
            keys = common.mix(sig * common._BASE + _BAND_SALT).view(np.int64).ravel()
            rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rep)], ["key", "rep"])


def forest(sig: np.ndarray, need: float) -> list[tuple[int, int]]:
    """Edges that join all members whose similarity estimate reaches ``need``, as comparing all pairs would.

    Each unjoined member in turn is compared with all members; those of its own component need no comparing again.
    """
    m = len(sig)
    root = np.arange(m)
    edges = []
    for i in range(m):
        rest = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])  # earlier members were compared in their turn
        near = rest[(sig[rest] == sig[i]).mean(axis=1) >= need] if len(rest) else rest
        if len(near):
            other, first = np.unique(root[near], return_index=True)
            edges += [(i, int(j)) for j in near[first]]
            root[np.isin(root, other)] = root[i]
    return edges


def _link(need: float):
    @common.trimmed
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0).to_pylist():
                ids = [x["rep"] for x in members]
                sig = np.frombuffer(b"".join(x["sig"] for x in members), np.uint16).reshape(len(ids), 2 * PERMUTATIONS)
                for i, j in forest(sig, need):
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return link


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of (a, b) edges.

    Labels take the minimum over neighbours, then the label of their label, until nothing changes; the doubling keeps the
    number of rounds logarithmic in the longest chain. Each round is a table in the shared folder.
    """
    both = common.saved(edges.union(edges.select("b", "a")).distinct(), "edges")
    held = labels = common.saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        step = labels.join(seen, F.col("node") == F.col("n")).select("node", "label", F.least("label", "near").alias("new"))
        up = step.select(F.col("node").alias("p"), F.col("new").alias("of_p"))
        after = common.saved(step.join(up, F.col("new") == F.col("p")).select("node", "label", F.least("new", "of_p").alias("new")),
            "labels")
        common.discard(held)
        held, labels = after, after.select("node", F.col("new").alias("label"))
        if after.where("new <> label").isEmpty():
            common.discard(both)
            return labels


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id) of every document that has a near duplicate; group_id is the smallest id of its group."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    signed = own.mapInArrow(_sign, "doc_id bigint, sig binary").withColumns({"k1": F.xxhash64("sig"),
            "k2": F.xxhash64(F.reverse(F.hex("sig")))})
    signed = common.saved(signed, "signed")
    unique = common.saved(signed.groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("n"), F.first("sig").alias("sig")), "unique")
    # one id may stand for several signatures if rows repeat it with other texts; its first is kept
    buckets = unique.select("rep", "sig").mapInArrow(_band,
        "key bigint, rep bigint").groupBy("key").agg(F.array_sort(F.collect_set("rep")).alias("reps")).where(F.size("reps") > 1)
    buckets = buckets.select("reps").distinct().select(F.xxhash64("reps").alias("bucket"), F.explode("reps").alias("rep"))
    members = buckets.join(unique.select("rep", "sig"),
        "rep").groupBy("bucket").agg(F.collect_list(F.struct("rep", "sig")).alias("members"))
    edges = common.saved(members.select("members").mapInArrow(_link(threshold), "a bigint, b bigint").distinct(), "pairs")
    joined = unique.select("k1", "k2", "rep", "n").join(components(edges), F.col("rep") == F.col("node"), "left")
    labelled = joined.where("label IS NOT NULL OR n > 1").select("k1", "k2", F.coalesce("label", "rep").alias("group_id"))
    return signed.select("doc_id", "k1", "k2").join(labelled, ["k1", "k2"]).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of near duplicates.

    Of rows that repeat an id one stays, that of the last text; other rows, null ids and texts among them, stay with all columns as they are.
    """
    gone = common.saved(groups(docs, threshold).where("doc_id <> group_id").select("doc_id"), "gone")
    own = common.quoted(docs.columns)
    kept = docs.join(common.small(gone), "doc_id", "left_anti").select(*own)
    twice = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = common.saved(twice, "twice")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, "doc_id", "left_semi").select(*own)
    n = common.fresh(docs.columns)
    order = [F.col("text").desc_nulls_last(),
        *(F.col(q).asc_nulls_last() for q, (c, kind) in zip(own, docs.dtypes) if c not in ("doc_id", "text")
            and not re.search("map<|variant|interval", kind))]
    again = again.withColumn(n, F.row_number().over(W.partitionBy("doc_id").orderBy(*order))).where(F.col(n) == 1).drop(n)
    return kept.join(twice, "doc_id", "left_anti").select(*own).unionByName(again)

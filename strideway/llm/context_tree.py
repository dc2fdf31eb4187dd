"""Code length per byte by context-tree weighting.

Every byte is eight binary decisions; each decision (the bits of the byte so far) has a context tree over the ``DEPTH`` bytes
before it. A node with ``a`` zeros and ``b`` ones gives the Krichevsky-Trofimov estimate of its bits; its weighted probability is
the mean of that and the product of its children's, so all depths are mixed. The counts come from the whole corpus, in two
halves by a hash of the id: each document is scored by the tree of the half without it, so that no document predicts itself.

The corpus is reduced to its runs of ``DEPTH + 1`` bytes with counts; the trees are worked out in partitions by the last two
bytes of the context (all deeper nodes are inside one; a pair has 2^24 runs at most, however large the corpus), and only the nodes of depth 0 and 1, at most 65,535, meet on the driver.
A table of up to ``SEND_LIMIT`` runs is sent to the tasks that score; a larger one is joined by shuffle.

Defined results: a null text has null lengths; an empty one has 0 bytes, 0 bits and a null rate. Before its first byte a text
has zero bytes as context. Null ids belong to the first half. Repeated rows are scored, and counted, as often as they occur.
Very long texts are counted and scored in whole. Equal texts of one half have equal lengths. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH = 4
SEND_LIMIT = 4_000_000
CHUNK = 4_000_000
_U = np.uint64
_HALF = np.log(0.5)


def lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for x > 0 by Stirling's series, after a shift by 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of a sequence of ``a`` zeros and ``b`` ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - np.log(np.pi)


def runs(texts: list[str], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of all texts with the ``depth`` bytes before it as one number, and where each text begins."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    a = np.frombuffer(b"".join(b"\0" * depth + p for p in parts), np.uint8).astype(_U)
    n = np.array([len(p) for p in parts], np.int64)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(n, out=starts[1:])
    if not starts[-1]:
        return np.zeros(0, _U), starts
    g = a[depth:].copy()
    for d in range(1, depth + 1):
        g |= a[depth - d : len(a) - d] << _U(8 * d)
    at = np.arange(starts[-1]) + np.repeat(depth * np.arange(len(parts)), n)
    return g[at], starts


def _gather(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            texts, half = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(_U)
            for i, j in common.chunks(texts, CHUNK):
                g, starts = runs(texts[i:j], depth)
                k, n = np.unique(g << _U(1) | np.repeat(half[i:j], np.diff(starts)), return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
            if held > 8 * CHUNK // 4 and len(keys) > 1:
                k, n = merged()
                keys, counts, held = [k], [n], 0
        if keys:
            k, n = merged()
            for i in range(0, len(k), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array((k[i : i + (1 << 20)] >> _U(1)).view(np.int64)),
                        pa.array((k[i : i + (1 << 20)] & _U(1)).astype(np.int32)), pa.array(n[i : i + (1 << 20)])], ["run", "half", "n"])

    return run


def gather(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(run, n0, n1): counts in both halves of every run of ``depth + 1`` bytes in the corpus."""
    own = docs.where("text IS NOT NULL").select("doc_id", "text", half(docs))
    n = lambda k: F.sum(F.when(F.col("half") == k, F.col("n")).otherwise(0))
    return own.mapInArrow(_gather(depth), "run bigint, half int, n bigint").groupBy("run").agg(n(0).alias("n0"), n(1).alias("n1"))


def half(docs: DataFrame):
    return F.when(F.col("doc_id").isNull(),
        0).otherwise(F.xxhash64(F.col("doc_id").cast("bigint")).bitwiseAND(F.lit(1).cast("bigint"))).cast("int").alias("half")


class Trees:
    """The nodes of depth ``top`` to ``depth`` over runs that hold whole subtrees of depth ``top``, for one half's counts.

    ``keys[d]`` has a node's context of d bytes, the nearest byte highest, over its decision of 1 to 255; ``parent[d]`` its place at d - 1.
    """

    def __init__(self, run: np.ndarray, n: np.ndarray, depth: int, top: int) -> None:
        self.depth, self.top = depth, top
        byte = (run & _U(255)).astype(np.int64)
        context = np.zeros(len(run), _U)
        for d in range(1, depth + 1):
            context = context << _U(8) | (run >> _U(8 * d)) & _U(255)
        k = np.arange(8)
        decision = (1 << k) | byte[:, None] >> (8 - k)
        self.bit = ((byte[:, None] >> (7 - k)) & 1).ravel()
        node = (context[:, None] << _U(8) | decision.astype(_U)).ravel()
        weight = np.repeat(n.astype(float), 8)
        self.keys: dict[int, np.ndarray] = {}
        self.up: dict[int, np.ndarray] = {}
        self.keys[depth], self.leaf = np.unique(node, return_inverse=True)
        size = len(self.keys[depth])
        self.zeros = {depth: np.bincount(self.leaf, weight * (1 - self.bit), size)}
        self.ones = {depth: np.bincount(self.leaf, weight * self.bit, size)}
        self.kt = {depth: log_kt(self.zeros[depth], self.ones[depth])}
        self.log = {depth: self.kt[depth]}
        for d in range(depth - 1, top - 1, -1):
            below = self.keys[d + 1]
            self.keys[d], self.up[d + 1] = np.unique(below >> _U(16) << _U(8) | below & _U(255), return_inverse=True)
            size, up = len(self.keys[d]), self.up[d + 1]
            self.zeros[d], self.ones[d] = np.bincount(up, self.zeros[d + 1], size), np.bincount(up, self.ones[d + 1], size)
            self.kt[d] = log_kt(self.zeros[d], self.ones[d])
            self.log[d] = np.logaddexp(self.kt[d], np.bincount(up, self.log[d + 1], size)) + _HALF

    def chances(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each node's own estimate at its depth, and that estimate of a one."""
        own = np.ones(len(self.keys[d])) if d == self.depth else np.exp(np.minimum(self.kt[d] + _HALF - self.log[d], 0.0))
        return own, (self.ones[d] + 0.5) / (self.zeros[d] + self.ones[d] + 1)

    def lengths(self, above: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Bits of each run's last byte. ``above``: for keys of depth ``top``, the mixed estimate so far and the weight left."""
        mixed, left = above(self.keys[self.top])
        for d in range(self.top, self.depth + 1):
            if d > self.top:
                mixed, left = mixed[self.up[d]], left[self.up[d]]
            own, one = self.chances(d)
            mixed, left = mixed + left * own * one, left * (1 - own)
        p = np.clip(mixed[self.leaf], 1e-12, 1 - 1e-12)
        return -np.log2(np.where(self.bit == 1, p, 1 - p)).reshape(-1, 8).sum(axis=1)


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, list[np.ndarray]]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return np.zeros(0, _U), [np.zeros(0), np.zeros(0)]
    cols = [np.concatenate([b.column(c).to_numpy() for b in got]) for c in range(3)]
    return cols[0].view(_U), cols[1:]


#: Runs of which trees are held at a time; those of one pair of nearest bytes, 2^24 at most, stay together.
HELD = 1 << 19


def _by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """A partition's runs and counts, cut between pairs of nearest context bytes."""
    run_, counts = _whole(batches)
    pair = run_ >> _U(8) & _U(65535)
    order = np.argsort(pair, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(pair[order])) + 1, len(order))
    at = 0
    while at < len(order):
        k = np.searchsorted(ends, at + HELD, "right")
        end = int(ends[k - 1]) if k and ends[k - 1] > at else int(ends[np.searchsorted(ends, at, "right")])
        part = order[at:end]
        yield run_[part], [n[part] for n in counts]
        at = end


def _near_roots(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_, counts in _by_pair(batches):
            for h, n in enumerate(counts):
                t = Trees(run_, n, depth, 2)
                yield pa.RecordBatch.from_arrays([pa.array((t.keys[2] >> _U(16) << _U(8) | t.keys[2] & _U(255)).view(np.int64)),
                        pa.array(np.full(len(t.log[2]), h, np.int32)), pa.array(t.zeros[2]), pa.array(t.ones[2]), pa.array(t.log[2])],
                    ["node", "half", "zeros", "ones", "log"])

    return run


def _roots(rows: list, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """By key of depth 1: the estimate mixed over depths 0 and 1, and the weight left for deeper nodes, for one half."""
    node = np.array([r[0] for r in rows], np.int64)
    zeros, ones, log = (np.zeros(1 << 16) for _ in range(3))
    zeros[node], ones[node], log[node] = ([r[k] for r in rows] for k in (2, 3, 4))
    there = np.zeros(1 << 16, bool)
    there[node] = True
    kt1 = log_kt(zeros, ones)
    log1 = np.where(there, np.logaddexp(kt1, log) + _HALF, 0.0)
    z0, o0, s0 = (x.reshape(256, 256).sum(axis=0) for x in (zeros, ones, log1))
    kt0 = log_kt(z0, o0)
    own0 = np.exp(np.minimum(kt0 + _HALF - (np.logaddexp(kt0, s0) + _HALF), 0.0))
    own1 = np.where(there, np.exp(np.minimum(kt1 + _HALF - log1, 0.0)), 1.0)
    one0, one1 = (o0 + 0.5) / (z0 + o0 + 1), (ones + 0.5) / (zeros + ones + 1)
    d = np.arange(1 << 16) & 255
    return own0[d] * one0[d] + (1 - own0[d]) * own1 * one1, (1 - own0[d]) * (1 - own1)


def _price(depth: int, roots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_, counts in _by_pair(batches):
            bits = []
            for (mixed, left), n in zip(roots.value, counts):
                place = lambda key, m=mixed, w=left: (m[i := (key >> _U(16) << _U(8) | key & _U(255)).astype(np.int64)], w[i])
                bits.append(Trees(run_, n, depth, 2).lengths(place).astype(np.float32))
            # a document of the first half is scored by the counts of the second, and the other way round
            for i in range(0, len(run_), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 20)]) for x in (run_.view(np.int64), bits[1], bits[0])],
                    ["run", "bits0", "bits1"])

    return run


def prices(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(run, bits0, bits1): the code length of each run's last byte for documents of either half."""
    if depth < 2:
        raise ValueError("depth is at least 2")
    spark = counts.sparkSession
    split = counts.select("run", "n0", "n1").repartition(F.shiftright("run", 8).bitwiseAND(F.lit(65535).cast("bigint")))
    near = split.mapInArrow(_near_roots(depth), "node bigint, half int, zeros double, ones double, log double")
    rows = near.groupBy("node", "half").agg(F.sum("zeros"), F.sum("ones"), F.sum("log")).collect()
    roots = spark.sparkContext.broadcast([_roots([r for r in rows if r[1] == h], depth) for h in (0, 1)])
    return split.mapInArrow(_price(depth, roots), "run bigint, bits0 float, bits1 float")


_ODD = _U(0x9E3779B97F4A7C15)


class Lookup:
    """Places in a table of runs sorted by their hashes, an odd multiple, found for whole arrays at once.

    The highest bits of a hash say where to begin; with two such places a run the next one or two are looked at. That takes little more
    memory than the hashes themselves.
    """

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        size = max(8, len(hashes).bit_length() + 1)
        self.shift = _U(64 - size)
        self.begin = np.zeros(1 << size, np.int32)
        counts = np.bincount((hashes >> self.shift).astype(np.int64), minlength=1 << size)
        np.cumsum(counts[:-1], out=self.begin[1:])

    @staticmethod
    def hashed(keys: np.ndarray) -> np.ndarray:
        return keys * _ODD

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each run; every one is in the table."""
        h = self.hashed(keys)
        at = self.begin[(h >> self.shift).astype(np.int64)]
        miss = np.flatnonzero(self.hashes[at] != h)
        while len(miss):
            at[miss] += 1
            miss = miss[self.hashes[at[miss]] != h[miss]]
        return at


def _score(table, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bits = table.value
        find = Lookup(keys)
        for batch in batches:
            texts, side = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in common.chunks(texts):
                g, starts = runs(["" if t is None else t for t in texts[i:j]], depth)
                n = np.diff(starts)
                each = bits.ravel()[2 * find(g).astype(np.int64) + np.repeat(side[i:j], n)]
                total = np.zeros(len(each) + 1)
                np.cumsum(each, out=total[1:])
                null = np.array([t is None for t in texts[i:j]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, mask=null),
                        pa.array(np.diff(total[starts]), mask=null)], ["doc_id", "n_bytes", "bits"])

    return run


def _own_runs(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            row, key, count = [], [], []
            for r, t in zip(batch.column(0).to_pylist(), texts):
                k, n = np.unique(runs([t], depth)[0], return_counts=True)
                row.append(np.full(len(k), r))
                key.append(k.view(np.int64))
                count.append(n)
            if row:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (row, key, count)], ["row", "run", "n"])

    return run


def code_lengths(docs: DataFrame, depth: int = DEPTH, send_limit: int = SEND_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every row."""
    spark = docs.sparkSession
    found = common.saved(prices(common.saved(gather(docs, depth), "runs"), depth), "prices")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", half(docs))
    if found.count() <= send_limit:
        t = found.toArrow()
        keys = t["run"].to_numpy().view(_U)
        keys = Lookup.hashed(keys)
        order = np.argsort(keys)
        keys, bits = keys[order], np.stack([t["bits0"].to_numpy(), t["bits1"].to_numpy()], axis=1)[order]
        out = own.mapInArrow(_score(spark.sparkContext.broadcast((keys, bits)), depth), "doc_id bigint, n_bytes bigint, bits double")
    else:
        rows = common.saved(own.withColumn("row", F.monotonically_increasing_id()), "numbered")
        each = rows.where("text IS NOT NULL").select("row", "text").mapInArrow(_own_runs(depth), "row bigint, run bigint, n bigint")
        sums = each.join(rows.select("row", "half"), "row").join(found,
            "run").groupBy("row").agg(F.sum(F.col("n") * F.when(F.col("half") == 0, F.col("bits0")).otherwise(F.col("bits1"))
                .cast("double")).alias("bits"))
        out = rows.join(sums, "row", "left").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"),
            F.when(F.col("text").isNotNull(), F.coalesce("bits", F.lit(0.0))).alias("bits"))
    return out.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")))

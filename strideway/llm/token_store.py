"""Token ids in blocks coded by an adaptive context-mixing range coder.

Documents are encoded to token ids, laid end to end and cut into blocks of ``BLOCK`` ids. Every block is modelled from
nothing, so it can be read alone, and carries a CRC-32 of its ids. For each id the model mixes three predictions: the id that
last followed the two ids before it (order 2), the one that last followed the id before it (order 1), and the id counts so far
over a falling prior (order 0). The weights are the hit rates of the predictions so far in each state of their past hits;
counts and weights are brought up to date after at most ``STEP`` ids. A block's ids are dealt to ``LANES`` range coders that run
in step, so that both model and coder are array operations.

Defined results: a null text has length -1 and no ids, an empty one length 0. A text longer than a block goes on in the next.
Rows with null or repeated ids are stored like others, in their order. Very long texts are stored in whole. Which rows share a block
follows the partitions, and so does ``block_id``, which orders the blocks of one. Other columns are not stored. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

VOCAB = common.env_path("STRIDEWAY_TOKEN_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK, STEP, LANES = 32768, 4096, 32
#: Blocks that are coded together; bounds the memory of a task.
TOGETHER = 64
BITS = 24
TOTAL = 1 << BITS
STATES = 5
_FIRST = 3  # a prediction counts this much against those for which order 0 was right

SCHEMA = "block_id bigint, doc_ids array<bigint>, lengths array<int>, continued boolean, n_tokens int, payload binary, crc32 bigint"


def _prior(size: int) -> np.ndarray:
    return np.maximum(1, (40_000 / (np.arange(size) + 50)).astype(np.int64))


def _last(keys: list[np.ndarray]) -> np.ndarray:
    """For each place the last place before with equal keys, or -1. Keys are 16-bit, so that the stable sort is a radix sort."""
    order = np.argsort(keys[-1], kind="stable")
    for k in keys[-2::-1]:
        order = order[np.argsort(k[order], kind="stable")]
    same = np.ones(len(order) - 1, bool)
    for k in keys:
        s = k[order]
        same &= s[1:] == s[:-1]
    out = np.empty(len(order), np.int64)
    out[order[:1]] = -1
    out[order[1:]] = np.where(same, order[:-1], -1)
    return out


def _order(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each place's prediction (-1: none) and state: 0 without one, else 1 plus the hits of its context's last two predictions."""
    n = len(ids)
    guess, state = np.full(n, -1, np.int32), np.zeros(n, np.int32)
    if n <= depth:
        return guess, state
    last = _last([ids[depth - 1 - d : n - 1 - d] for d in range(depth)])
    own = ids[depth:].astype(np.int32)
    g = np.append(own, np.int32(-1))[last]  # place -1 is the appended one
    hit = g == own
    past = np.append(hit, False)[last].astype(np.int32) + 1
    older = np.append(past, np.int32(0))[last] == 2
    guess[depth:] = g
    state[depth:] = (past + 2 * older) * (last >= 0)
    return guess, state


def _weights(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies of the two predictions by joint state, of ``TOTAL``; order 0 keeps at least a 64th."""
    n = stats.sum(axis=1) + 4
    room = TOTAL - TOTAL // 64
    return (stats[:, 0] + _FIRST) * room // (n + 3), (stats[:, 1] + 1) * room // (n + 3)


def _steps(n: int) -> Iterator[tuple[int, int]]:
    """Places at which counts are brought up to date: often at first, then after every ``STEP`` ids."""
    b, size = 0, STEP // 16
    while b < n:
        yield b, min(b + size, n)
        b += size
        size = min(b, STEP)


def model(ids: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, frequency) of each id of a block, of ``TOTAL``."""
    n = len(ids)
    g2, s2 = _order(ids, 2)
    g1, s1 = _order(ids, 1)
    alike = g1 == g2
    state = s2 * STATES + s1 + STATES * STATES * alike
    own = ids.astype(np.int32)
    is2 = own == g2
    is1 = (own == g1) & ~alike
    right = 3 * state + 2 - 2 * is2 - is1
    has2, has1 = g2 >= 0, (g1 >= 0) & ~alike
    less2, less1 = has2 & (g2 < own), has1 & (g1 < own)
    low, freq = np.empty(n, np.int64), np.empty(n, np.int64)
    counts, stats = _prior(vocab), np.zeros((2 * STATES * STATES, 3), np.int64)
    upto = np.zeros(vocab + 1, np.int64)
    for b, e in _steps(n):
        w2, w1 = _weights(stats)
        x, st = own[b:e], state[b:e]
        f2, f1 = w2[st], w1[st]
        np.cumsum(counts, out=upto[1:])
        scale = (TOTAL - vocab - f2 * has2[b:e] - f1 * has1[b:e]) / upto[-1]
        lo = (upto[x] * scale).astype(np.int64)
        freq[b:e] = (upto[x + 1] * scale).astype(np.int64) - lo + 1 + f2 * is2[b:e] + f1 * is1[b:e]
        low[b:e] = lo + x + f2 * less2[b:e] + f1 * less1[b:e]
        np.add.at(counts, x, 32)
        stats += np.bincount(right[b:e], minlength=stats.size).reshape(stats.shape)
    return low, freq


def code(low: np.ndarray, freq: np.ndarray) -> list[bytes]:
    """Range-codes each column's (low, frequency) pairs; one of frequency ``TOTAL`` takes no room. Carries are settled at the end."""
    steps, lanes = low.shape
    base, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    words, at = np.zeros((steps + 8, lanes), np.int64), np.zeros(lanes, np.int64)
    for k in range(steps):
        span >>= BITS
        base += span * low[k]
        span *= freq[k]
        small = np.flatnonzero(span < (1 << 32))
        while len(small):
            if k + 8 >= len(words) or at[small].max() + 8 >= len(words):
                words = np.concatenate([words, np.zeros_like(words)])
            b = base[small]
            words[at[small], small] = b >> 32
            at[small] += 1
            base[small] = (b & 0xFFFFFFFF) << 16
            s = span[small] << 16
            span[small] = s
            small = small[s < (1 << 32)]
    cols = np.arange(lanes)
    for _ in range(3):
        words[at, cols] = base >> 32
        at += 1
        base = (base & 0xFFFFFFFF) << 16
    carry = np.zeros(lanes, np.int64)
    for k in range(int(at.max()) - 1, -1, -1):
        w = words[k] + carry
        carry = w >> 16
        words[k] = w & 0xFFFF
    out = np.ascontiguousarray(words[: at.max()].T.astype(">u2"))
    return [out[i, : at[i]].tobytes() for i in range(lanes)]


def encode_blocks(blocks: list[np.ndarray], vocab: int) -> list[bytes]:
    """The payload of each block: the lanes' sizes in bytes as 16-bit numbers, then the lanes."""
    steps = max(-(-len(b) // LANES) for b in blocks)
    low, freq = np.empty((2, steps, len(blocks) * LANES), np.int64)
    for i, ids in enumerate(blocks):
        a = np.empty((2, steps * LANES), np.int64)
        a[:, : len(ids)] = model(ids, vocab)
        a[0, len(ids) :], a[1, len(ids) :] = 0, TOTAL
        low[:, i * LANES : (i + 1) * LANES], freq[:, i * LANES : (i + 1) * LANES] = a.reshape(2, steps, LANES)
    lanes = code(low, freq)
    parts = (lanes[i * LANES : (i + 1) * LANES] for i in range(len(blocks)))
    return [np.array([len(x) for x in p], ">u2").tobytes() + b"".join(p) for p in parts]


def decode_block(payload: bytes, n: int, vocab: int, crc: int) -> np.ndarray:
    """The ids of one block, without any other. Raises ValueError where the checksum differs."""
    sizes = np.frombuffer(payload[: 2 * LANES], ">u2").astype(int)
    cuts = np.concatenate([[2 * LANES], 2 * LANES + np.cumsum(sizes)])
    lanes = [[payload[cuts[i] : cuts[i + 1]], 6, int.from_bytes(payload[cuts[i] : cuts[i] + 6].ljust(6, b"\0"), "big"), 1 << 48]
        for i in range(LANES)]
    ids: list[int] = []
    counts, stats = _prior(vocab), np.zeros((2 * STATES * STATES, 3), np.int64)
    seen: list[dict] = [{}, {}]  # context -> (id, hit, hit before)
    index = np.arange(vocab)
    for b, e in _steps(n):
        w2, w1 = (w.tolist() for w in _weights(stats))
        upto = np.cumsum(counts)
        total = int(upto[-1])
        fresh = np.zeros_like(stats)
        for i in range(b, e):
            keys = [tuple(ids[i - d : i]) if i >= d else None for d in (2, 1)]
            got = [s.get(k) if k is not None else None for s, k in zip(seen, keys)]
            (p2, s2), (p1, s1) = ((g[0], 1 + g[1] + 2 * g[2]) if g else (-1, 0) for g in got)
            st = s2 * STATES + s1 + STATES * STATES * (p1 == p2)
            f2 = w2[st] if p2 >= 0 else 0
            f1 = w1[st] if p1 >= 0 and p1 != p2 else 0
            scale = (TOTAL - vocab - f2 - f1) / total
            lane = lanes[i % LANES]
            r = lane[3] >> BITS
            want = min(lane[2] // r, TOTAL - 1)

            def low_of(x: int, f2: int = f2, f1: int = f1, p2: int = p2, p1: int = p1, scale: float = scale) -> int:
                below = int(upto[x - 1]) if x else 0
                return int(below * scale) + x + (f2 if p2 < x else 0) + (f1 if p1 < x else 0)

            lo, hi = 0, vocab - 1
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if low_of(mid) <= want:
                    lo = mid
                else:
                    hi = mid - 1
            x = lo
            start = low_of(x)
            below = int(upto[x - 1]) if x else 0
            f = int(int(upto[x]) * scale) - int(below * scale) + 1 + (f2 if p2 == x else 0) + (f1 if p1 == x else 0)
            lane[2] -= r * start
            lane[3] = r * f
            while lane[3] < 1 << 32:
                lane[3] <<= 16
                lane[2] = lane[2] << 16 | int.from_bytes(lane[0][lane[1] : lane[1] + 2].ljust(2, b"\0"), "big")
                lane[1] += 2
            fresh[st, 0 if x == p2 else 1 if x == p1 else 2] += 1
            for s, k, g in zip(seen, keys, got):
                if k is not None:
                    s[k] = (x, int(g[0] == x), g[1]) if g else (x, 0, 0)
            ids.append(x)
        counts = counts + 32 * np.bincount(np.array(ids[b:], np.int64), minlength=len(index))
        stats += fresh
    out = np.array(ids, np.uint16)
    if zlib.crc32(out.astype("<u2").tobytes()) != crc:
        raise ValueError("a block's checksum differs")
    return out


_ENCODER: dict = {}


def encoder(path: str = VOCAB):
    """The byte-level encoder of a vocabulary file of ranks; ids are below 65,536."""
    if path not in _ENCODER:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        _ENCODER[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1
    return _ENCODER[path]


def _write(path: str):
    @common.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, vocab = encoder(path)
        task = TaskContext.get()
        block_id = (task.partitionId() if task else 0) << 33
        ready: list[tuple] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size, continued = 0, False

        def cut() -> None:
            nonlocal size, held, doc_ids, lengths
            ready.append((doc_ids, lengths, continued, np.concatenate(held) if held else np.zeros(0, np.uint16)))
            doc_ids, lengths, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block_id
            coded = encode_blocks([r[3] for r in ready], vocab)
            crc = [zlib.crc32(r[3].astype("<u2").tobytes()) for r in ready]
            keys = list(range(block_id, block_id + len(ready)))
            block_id += len(ready)
            cols = [pa.array(keys), pa.array([r[0] for r in ready], pa.list_(pa.int64())),
                pa.array([r[1] for r in ready], pa.list_(pa.int32())), pa.array([r[2] for r in ready])]
            cols += [pa.array([len(r[3]) for r in ready], pa.int32()), pa.array(coded, pa.binary()), pa.array(crc, pa.int64())]
            ready.clear()
            return pa.RecordBatch.from_arrays(cols, ["block_id", "doc_ids", "lengths", "continued", "n_tokens", "payload", "crc32"])

        for batch in common.slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                if not text:
                    lengths.append(-1 if text is None else 0)
                    continue
                ids = enc.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)
                while size + len(ids) >= BLOCK:
                    part = ids[: BLOCK - size]
                    lengths.append(len(part))
                    held.append(part)
                    ids = ids[len(part) :]
                    cut()
                    continued = bool(len(ids))
                    if not continued:
                        break
                    doc_ids.append(doc_id)
                else:
                    lengths.append(len(ids))
                    held.append(ids)
                    size += len(ids)
                if len(ready) >= TOGETHER:
                    yield flush()
        if doc_ids:
            cut()
        if ready:
            yield flush()

    return run


def write_blocks(docs: DataFrame, path: str = VOCAB) -> DataFrame:
    """Blocks of coded ids of all rows in their order. ``continued``: the block's first text began in the block before."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_write(path), SCHEMA)


def read_blocks(blocks: list[dict], path: str = VOCAB) -> list[tuple[int | None, str | None]]:
    """The (doc_id, text) rows of one partition's blocks in order."""
    enc, vocab = encoder(path)
    rows: list[list] = []
    for b in blocks:
        ids = decode_block(b["payload"], b["n_tokens"], vocab, b["crc32"])
        at = 0
        for k, (doc_id, n) in enumerate(zip(b["doc_ids"], b["lengths"])):
            if k == 0 and b["continued"]:
                rows[-1][1] += ids[:n].tolist()
            else:
                rows.append([doc_id, None if n < 0 else ids[at : at + n].tolist()])
            at += max(n, 0)
    return [(d, None if x is None else enc.decode(x)) for d, x in rows]


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, vocab = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for b in batch.to_pylist():
                ids = decode_block(b["payload"], b["n_tokens"], vocab, b["crc32"])
                at = 0
                for k, (doc_id, n) in enumerate(zip(b["doc_ids"], b["lengths"])):
                    part = b"".join(enc.decode_tokens_bytes(ids[at : at + n].tolist())) if n >= 0 else None
                    out.append((b["block_id"], k, k == 0 and b["continued"], doc_id, part))
                    at += max(n, 0)
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                ["block_id", "place", "continued", "doc_id", "part"])

    return run


def read_table(blocks: DataFrame, path: str = VOCAB) -> DataFrame:
    """(doc_id, text) of all rows of a table of blocks, every block decoded by itself; only texts cut by a block's end are put together."""
    parts = blocks.mapInArrow(_read(path), "block_id bigint, place int, continued boolean, doc_id bigint, part binary")
    parts = common.saved(parts, "parts")
    # a text that goes on over whole blocks begins in the last block with one that does not
    ends = parts.groupBy("block_id").agg(F.max("place").alias("last"), F.bool_or("continued").alias("goes_on"))
    nexts = ends.where("goes_on").select((F.col("block_id") - 1).alias("block_id"), F.lit(True).alias("cut"))
    ends = ends.join(nexts, "block_id", "left")
    chained = ends.where("goes_on OR cut").withColumn("partition", F.shiftright("block_id", 33))
    w = W.partitionBy("partition").orderBy("block_id")
    begins = F.when(~F.col("goes_on") | (F.col("last") > 0), F.col("block_id"))
    chained = chained.withColumn("first", F.when(F.col("cut"), F.last(begins, ignorenulls=True).over(w))).withColumn("head",
        F.lag("first").over(w))
    marked = parts.join(chained.select("block_id", "last", "goes_on", "cut", "first", "head"), "block_id", "left")
    at_end, at_start = (F.col("place") == F.col("last")) & F.coalesce("cut", F.lit(False)), F.col("continued")
    text = F.when(at_start, F.col("head")).when(at_end, F.col("first"))
    whole = marked.where(text.isNull()).select("doc_id", F.col("part").cast("string").alias("text"))
    joined = marked.where(text.isNotNull()).withColumn("text_of",
        text).groupBy("text_of").agg(F.array_sort(F.collect_list(F.struct("block_id", "doc_id", F.hex("part").alias("part")))).alias("p"))
    return whole.unionByName(joined.select(F.col("p")[0]["doc_id"].alias("doc_id"),
            F.unhex(F.array_join(F.transform("p", lambda x: x["part"]), "")).cast("string").alias("text")))

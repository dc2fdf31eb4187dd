"""Helpers shared by the corpus operators: vectorised word hashing, chunks of texts, names; and the shared-folder tables."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from strideway.storage import BROADCAST_BYTES, discard, saved, shared_dir, small, stored_bytes  # noqa: F401

U64 = np.uint64
_TABLE = np.random.Generator(np.random.PCG64(20240917)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_WORD = np.zeros(256, bool)
_WORD[0x80:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz_":
    _WORD[_c] = True
CHUNK_CHARS = 400_000


def fresh(columns: list[str]) -> str:
    """A name with which no column's name begins."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in columns):
        mark += "_"
    return mark


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, at least, of an odd base and of its inverse."""
    if not _POW or len(_POW[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        both = []
        for b in (_BASE, _BASE_INV):
            p = np.full(size, b, U64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U64))
        _POW[:] = both
    return _POW[0], _POW[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and each text's first word as offsets (one more than texts).

    A word is a run of letters, digits, underscores or characters beyond ASCII.
    """
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    a = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    is_word = _WORD[a]
    edge = np.flatnonzero(np.diff(is_word, prepend=False))
    s, e = edge[::2], edge[1::2]
    power, inverse = powers(len(a) + 1)
    total = np.zeros(len(a) + 1, U64)
    np.cumsum(_TABLE[a] * power[: len(a)], out=total[1:])
    return mix((total[e] - total[s]) * inverse[s]), np.searchsorted(s, starts)


def gram_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside one text, and offsets. A text of fewer words gives none."""
    n = len(words)
    if n < k:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    g = words[: n - k + 1].copy()
    for j in range(1, k):
        g *= _BASE
        g += words[j : n - k + 1 + j]
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=out[1:])
    keep = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], counts)
    return mix(g[keep]), out


def runs_of(a: np.ndarray, least: int = 1, most: int | None = None) -> np.ndarray:
    """(start, end, period) of the maximal repetitions in ``a`` that hold their period, of ``least`` or more, at least twice; of one stretch the least period.

    ``most``: no repetition has a longer period; as numbers that occur once part several sequences in ``a``, say.

    For periods from 2 L to 4 L, L a power of two, every L-th run of L numbers is looked up among all runs of L numbers: a repetition has
    one of them in its first round, and the same a period later. Hashes find how far a match extends; matches are then compared number by number.
    """
    n = len(a)
    none = np.zeros((0, 3), np.int64)
    if n < 2 * least:
        return none
    power, inverse = powers(n + 1)
    upto = np.zeros(n + 1, U64)
    np.cumsum(mix(a.astype(U64) + U64(1)) * power[:n], out=upto[1:])
    of = lambda i, size: (upto[i + size] - upto[i]) * inverse[i]
    found = [none]
    size = 1
    while 4 * size <= least:
        size *= 2
    most = n // 2 if most is None else most
    while size == 1 or (4 * size <= n and 2 * size <= most):
        first = least if size == 1 else max(2 * size, least)
        every = of(np.arange(n - size + 1), size)
        order = np.argsort(every, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ends = np.searchsorted(every[order], every[order], "right")
        # inside a known repetition nothing else repeats
        inside = np.zeros(n, np.int64)
        known = np.concatenate(found)
        np.maximum.at(inside, known[:, 0], known[:, 1])
        inside = np.maximum.accumulate(inside)
        p = np.arange(0, n - size + 1, size)
        p = p[inside[p] < np.minimum(p + 5 * size, n)]
        k, last = rank[p] + 1, ends[rank[p]]
        pairs = []
        while len(p):
            there = k < last
            p, k, last = p[there], k[there], last[there]
            gap = order[k] - p
            near = gap < 4 * size
            hit = near & (gap >= first)
            pairs.append(np.stack([p[hit], gap[hit]], axis=1))
            p, k, last = p[near], k[near] + 1, last[near]
        both = np.concatenate([*pairs, none[:, :2]])
        size *= 2
        p, u = both[:, 0], both[:, 1]
        q = p + u
        fore, back = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        step = 1 << int(min(n, 2 * most + 2 * size)).bit_length() if most < n // 4 else 1 << int(n).bit_length()
        while step and len(p):
            ok = np.flatnonzero(q + fore + step <= n)
            ok = ok[of(p[ok] + fore[ok], step) == of(q[ok] + fore[ok], step)]
            fore[ok] += step
            ok = np.flatnonzero(p - back - step >= 0)
            ok = ok[of(p[ok] - back[ok] - step, step) == of(q[ok] - back[ok] - step, step)]
            back[ok] += step
            step >>= 1
        runs = np.unique(np.stack([p - back, q + fore, u], axis=1)[fore + back >= u], axis=0)
        known = np.unique(np.concatenate([known, runs]), axis=0)  # by stretch, then period
        fresh = np.ones(len(known), bool)
        fresh[1:] = (known[1:, :2] != known[:-1, :2]).any(axis=1)
        found = [known[fresh]]
    runs = found[0]
    keep = [bool((a[s : e - w] == a[s + w : e]).all()) for s, e, w in runs.tolist()]
    return runs[np.array(keep, bool)]


def quoted(columns: list[str]) -> list[str]:
    """Names that ``select`` takes as they are, whatever is in them."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def chunks(texts: Iterable[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` characters, so that work arrays stay in cache; a longer text is a range of its own."""
    begin = size = i = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 1
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if size:
        yield begin, i + 1


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that few texts are Python strings at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def trimmed(run):
    """A task's function that gives freed memory back when it ends: workers are used again and would keep each stage's peak."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return task


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)

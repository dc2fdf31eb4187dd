"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, turn by turn, and encoded once; the tokens' byte spans follow from their lengths. A
token is trained on if it lies inside the content (or end mark) of a trained role's turn: the turn's span is found by binary
search among the sorted span starts. Marks inside a text are ordinary text, as spans come from offsets and not from the text.

Defined results: turns go by number, then role, then text, nulls first; repeated rows are rendered as often as they occur. A
null role is rendered as ``unknown``; a null or empty text as empty content. Rows with a null conv_id belong to no
conversation and are left out. A token that reaches over a border of a trained span is not trained on. Very long conversations
are rendered and encoded in whole. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_store

TRAINED = ("assistant",)
OPEN, AFTER_ROLE, CLOSE = b"<|", b"|>\n", b"<|end|>"
SCHEMA = "conv_id bigint, n_turns int, n_tokens int, n_trained int, token_ids array<int>, loss_mask array<tinyint>"
_SIZES: dict[str, np.ndarray] = {}


def token_bytes(path: str) -> np.ndarray:
    """The length in bytes of every id."""
    if path not in _SIZES:
        enc, vocab = token_store.encoder(path)
        _SIZES[path] = np.array([len(enc.decode_single_token_bytes(i)) for i in range(vocab)], np.int64)
    return _SIZES[path]


def render(turns: list[tuple[str | None, str | None]], trained: tuple[str, ...] = TRAINED) -> tuple[str, np.ndarray]:
    """The text of (role, text) turns and the sorted byte spans, (start, end) rows, that are trained on."""
    parts: list[bytes] = []
    spans, at = [], 0
    for role, text in turns:
        name = "unknown" if role is None else role.strip().lower()
        head = OPEN + name.encode("utf-8", "replace") + AFTER_ROLE
        body = (text or "").encode("utf-8", "replace")
        if name in trained:
            spans.append((at + len(head), at + len(head) + len(body) + len(CLOSE)))
        parts += [head, body, CLOSE, b"\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return b"".join(parts).decode(), np.array(spans, np.int64).reshape(-1, 2)


def mask(sizes: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """1 for each token, given by its size in bytes, that lies inside one of the spans."""
    end = np.cumsum(sizes)
    start = end - sizes
    if not len(spans):
        return np.zeros(len(sizes), np.int8)
    k = np.searchsorted(spans[:, 0], start, "right") - 1
    return ((k >= 0) & (end <= spans[np.maximum(k, 0), 1])).astype(np.int8)


def _format(path: str, trained: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = token_store.encoder(path)
        length = token_bytes(path)
        for batch in batches:
            turns, ids, masks, = [], [], []
            for conv in batch.column(1).to_pylist():
                text, spans = render([(t["role"], t["text"]) for t in conv], trained)
                own = enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
                turns.append(len(conv))
                ids.append(own)
                masks.append(mask(length[own], spans))
            if ids:
                n = np.array([len(x) for x in ids])
                at = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                cols = [batch.column(0), pa.array(turns, pa.int32()), pa.array(n, pa.int32()),
                    pa.array([int(m.sum()) for m in masks], pa.int32())]
                cols += [pa.ListArray.from_arrays(at, pa.array(np.concatenate(ids))),
                    pa.ListArray.from_arrays(at, pa.array(np.concatenate(masks)))]
                yield pa.RecordBatch.from_arrays(cols, ["conv_id", "n_turns", "n_tokens", "n_trained", "token_ids", "loss_mask"])

    return run


def format_chats(turns: DataFrame, path: str = token_store.VOCAB, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """(conv_id, n_turns, n_tokens, n_trained, token_ids, loss_mask) of every conversation."""
    own = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"),
            F.col("text").cast("string").alias("text")).alias("t"))
    whole = own.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return whole.mapInArrow(_format(path, trained), SCHEMA)

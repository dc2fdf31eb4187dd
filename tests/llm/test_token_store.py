"""Exact round trips, block independence and checksums."""

import numpy as np
import pytest

from strideway.llm import token_store


@pytest.fixture(scope="module")
def blocks(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").coalesce(1)
    return [r.asDict() for r in token_store.write_blocks(docs).collect()], [(r.doc_id, r.text) for r in docs.collect()]


def test_round_trip(blocks):
    rows, docs = blocks
    assert len(rows) > 1
    assert token_store.read_blocks(rows) == docs


def test_blocks_stand_alone_and_shrink(blocks):
    rows, _ = blocks
    _, vocab = token_store.encoder()
    last = rows[-1]
    ids = token_store.decode_block(last["payload"], last["n_tokens"], vocab, last["crc32"])
    assert len(ids) == last["n_tokens"] == sum(max(n, 0) for n in last["lengths"])
    assert sum(len(r["payload"]) for r in rows) < 0.6 * 2 * sum(r["n_tokens"] for r in rows)


def test_distributed_reader(spark, data):
    rows = [(1, "word " * 90_000), (2, None), (None, ""), (3, "ü€ x " * 30_000), (3, "again"), (4, "tail " * 40_000)]
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        stored = token_store.write_blocks(docs)
        got = [tuple(r) for r in token_store.read_table(stored).collect()]
        assert sorted(got, key=str) == sorted(rows, key=str)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert token_store.read_table(token_store.write_blocks(docs)).exceptAll(docs.select("doc_id", "text")).isEmpty()


def test_damage_is_seen(blocks):
    rows, _ = blocks
    _, vocab = token_store.encoder()
    r = rows[-1]
    bad = bytearray(r["payload"])
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        token_store.decode_block(bytes(bad), r["n_tokens"], vocab, r["crc32"])


@pytest.mark.parametrize("n", [0, 1, 2, 33, 5000])
def test_any_ids(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), np.zeros(n, int), rng.integers(0, 3, n)):
        ids = ids.astype(np.uint16)
        payload = token_store.encode_blocks([ids], 50_257)[0]
        import zlib

        assert (token_store.decode_block(payload, n, 50_257, zlib.crc32(ids.astype("<u2").tobytes())) == ids).all()

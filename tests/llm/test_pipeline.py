"""The pipeline against its operators applied one by one."""

import corpus_pipeline
import pytest

from strideway.llm import entropy_balance, minmax_dedup, queries, token_store, toxicity, winnowing


def test_stages_take_effect(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    cur = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, cur, data)
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxic(cur, labels).collect()}
            assert ids(out) == [d for d in ids(cur) if d not in bad]
        elif name == "near_duplicates":
            group = {r.doc_id: r.group_id for r in minmax_dedup.groups(cur).collect()}
            assert ids(out) == [d for d in ids(cur) if group.get(d, d) == d]
        elif name == "decontamination":
            hit = {r.doc_id for r in winnowing.hits(cur, bench).collect()}
            assert ids(out) == [d for d in ids(cur) if d not in hit]
        elif name == "mixture":
            n = {r.doc_id: r.copies for r in entropy_balance.rates(cur).collect()}
            assert ids(out) == sorted(d for d, c in n.items() for _ in range(c))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}")
            cur = spark.read.parquet(f"{tmp_path}/{k}")
    stored = sorted(d for r in out.collect() for i, d in enumerate(r.doc_ids) if i or not r.continued)
    assert stored == ids(cur)


def test_run_and_order(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixture", "token_blocks"]
    blocks = corpus_pipeline.run(spark, data).collect()
    assert blocks and {r.crc32 for r in blocks}
    _, vocab = token_store.encoder()
    one = min(blocks, key=lambda r: r.n_tokens)
    assert len(token_store.decode_block(one.payload, one.n_tokens, vocab, one.crc32)) == one.n_tokens


LONG = "alpha beta gamma delta " * 12_000
ITEM = " ".join(f"item{i}" for i in range(30))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "b"),
    (3, None, "en", None),
    (4, "", None, None),
    (None, "no id at all but words enough to count for something here", "en", "a"),
    (None, None, None, None),
    (5, LONG, "en", "hot"),
    (6, "you idiot, you moron, you are pathetic scum", "en", "hot"),
    (7, "before " + ITEM.upper() + " after", "de", "hot"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Folders of tables: nulls, repeats and very long texts; and empty ones."""
    out = []
    for rows in (ROWS, []):
        d = str(tmp_path_factory.mktemp("odd"))
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
        docs.selectExpr("*", "length(text) AS n_chars", "1 AS rate", "2 AS `__n`", "3 AS `a.b`",
            "array(map('k', 1)) AS extra").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(6, 0, 1), (None, 1, 1)] if rows else [],
            "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, ITEM), (None, ITEM), (2, None)] if rows else [],
            "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        out.append(d)
    return out


def test_odd_rows(spark, odd, tmp_path):
    cur = spark.read.parquet(f"{odd[0]}/documents.parquet")
    columns = cur.columns
    left = {"toxicity": [1, 1, 2, 3, 4, 5, 7], "near_duplicates": [1, 3, 4, 5, 7], "decontamination": [1, 3, 4, 5]}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, cur, odd[0])
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        cur = spark.read.parquet(f"{tmp_path}/{k}")
        if name in left:
            assert sorted(r.doc_id for r in cur.where("doc_id IS NOT NULL").select("doc_id").collect()) == left[name]
            assert cur.where("doc_id IS NULL").count() == 2
    blocks = corpus_pipeline.STAGES[-1][1](spark, cur, odd[0])
    assert sorted(map(str, token_store.read_table(blocks).collect())) == sorted(map(str, cur.select("doc_id", "text").collect()))


def test_empty_tables(spark, odd):
    docs = spark.read.parquet(f"{odd[1]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, odd[1]).count() == 0
    assert corpus_pipeline.run(spark, odd[1]).count() == 0


#: Queries with a row for each row of their table, or each id.
ROW_BY_ROW = {"op1_entropy_balance": "documents", "op4_cover_tree": "embeddings", "op5_context_tree": "documents", "op9_wrappers": "pages"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, data, name):
    n = queries.QUERIES[name](spark, data).count()
    assert n > 0 or name == "op2_guess_cost"  # the smallest table has no credentials
    if name in ROW_BY_ROW:
        assert n == spark.read.parquet(f"{data}/{ROW_BY_ROW[name]}.parquet").count()

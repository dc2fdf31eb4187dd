"""Every operator over nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from strideway.llm import chat_masks, context_tree, cover_tree, entropy_balance, guess_cost, minmax_dedup, token_store, toxicity, winnowing, wrappers

CLASHING = ["key", "rep", "sig", "label", "node", "h", "at", "id", "n", "z", "rate", "copies", "half", "score", "word", "group_id", "count",
    "__n", "run", "tokens", "text_"]
LONG = "alpha beta gamma delta " * 12_000 + "password=Zx81qqTv9"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (1, "another text under the same id", None, "b"),
        (2, None, "en", None),
        (3, "", None, None),
        (4, "   \n\t ", "de", "a"),
        (None, "no id at all but words enough to count for something here", "en", "a"),
        (None, None, None, None),
        (5, LONG, "en", "hot"),
        (6, "ü" * 50_000, "de", "hot"),
        (7, "x", "en", "a"),
        (8, "emoji \U0001f600 and \x00 control chars, you 1d​i0t", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in CLASHING})


def empty(df):
    return df.where("false")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_entropy_balance(docs):
    out = entropy_balance.rates(docs).collect()
    assert len(out) == docs.count()
    assert all(r.tokens == 0 for r in out if r.doc_id in (2, 3, 4))
    assert len({(r.rate, r.copies) for r in out if r.doc_id == 1 and r.tokens == 12}) == 1
    assert entropy_balance.rates(empty(docs)).count() == 0
    mixed = entropy_balance.mix(docs)
    assert mixed.columns == docs.columns
    assert entropy_balance.mix(empty(docs)).count() == 0


def test_guess_cost(docs):
    out = guess_cost.scan(docs).collect()
    assert [(r.doc_id, r.context, r.n_chars, r.secret) for r in out] == [(5, "password", 9, True)]
    assert out[0].place == LONG.index("Zx81")
    assert guess_cost.scan(empty(docs)).count() == 0


def test_context_tree(docs):
    out = context_tree.code_lengths(docs).collect()
    assert len(out) == docs.count()
    assert all((r.n_bytes is None) == (r.bits is None) for r in out)
    assert all(r.bits == 0 and r.bits_per_byte is None for r in out if r.n_bytes == 0)
    assert context_tree.code_lengths(empty(docs)).count() == 0


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 0, 0), (8, 0, 1), (None, None, 1), (9, 1, None)], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id for r in toxicity.toxic(docs, labels).collect()} == {8}
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert toxicity.reject(empty(docs), labels).count() == 0
    assert toxicity.toxic(docs, labels.where("false")).count() == 1


def test_winnowing(spark, docs):
    words = " ".join(f"item{i}" for i in range(30))
    bench = spark.createDataFrame([(1, words, 1), (1, words, 1), (2, None, 1), (None, words, 1), (3, "", 1), (4, "too short", 1)],
        "item_id bigint, text string, doc_id int")
    more = spark.createDataFrame([(20, "before " + words.upper() + " after"), (21, words[: len(words) // 3])], "doc_id bigint, text string")
    full = docs.select("doc_id", "text").unionByName(more).withColumns({c: F.lit(7) for c in CLASHING})
    assert [tuple(r) for r in winnowing.hits(full, bench).collect()] == [(20, 1, 1, 0, 30, 30)]
    kept = winnowing.decontaminate(full, bench)
    assert kept.columns == full.columns and kept.count() == full.count() - 1
    assert winnowing.hits(empty(full), bench).count() == 0
    assert winnowing.decontaminate(full, bench.where("false")).count() == full.count()


def test_minmax_dedup(docs):
    assert minmax_dedup.groups(empty(docs)).count() == 0
    groups = {r.doc_id: r.group_id for r in minmax_dedup.groups(docs).collect()}
    assert groups == {3: 3, 4: 3}  # texts without words
    kept = minmax_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 5, 6, 7, 8]
    assert kept.where("doc_id IS NULL").count() == 2
    assert minmax_dedup.keep_one(empty(docs)).count() == 0


def test_token_store(docs):
    blocks = [r.asDict() for r in token_store.write_blocks(docs.coalesce(1)).collect()]
    assert token_store.read_blocks(blocks) == [(r.doc_id, r.text) for r in docs.coalesce(1).collect()]
    assert token_store.write_blocks(empty(docs)).count() == 0


def test_chat_masks(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (1, None, None, "?"),
        (None, 0, "user", "lost"), (2, 0, "ASSISTANT ", ""), (3, 0, "user", LONG)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(1)
            for c in ("turns", "t", "token_ids", "loss_mask")})
    out = {r.conv_id: r for r in chat_masks.format_chats(turns).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {1: 5, 2: 1, 3: 1}
    assert out[3].n_trained == 0 and out[2].n_trained > 0
    enc, _ = token_store.encoder()
    assert enc.decode(out[1].token_ids) == "<|unknown|>\n?<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\n<|end|>\n<|assistant|>\nyes<|end|>\n<|assistant|>\nyes<|end|>\n"
    assert chat_masks.format_chats(empty(turns)).count() == 0


def test_cover_tree(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]),
        (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (2, [0.0, 1.0]), (9, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(1)
            for c in ("id", "dim", "vec", "block", "node")})
    alone = {(i, i, 0) for i in (3, 4, 5, 6, 7, 8)}
    assert {tuple(r) for r in cover_tree.classes(df).collect()} == {(1, 1, 1), (2, 1, 2), (9, 1, 1)} | alone
    assert cover_tree.classes(empty(df)).count() == 0


def test_wrappers(spark):
    page = "<html><body><h1>{}</h1><p>same</p></body></html>"
    rows = [(1, "http://a.b/1", page.format("one")), (2, "http://a.b/2", page.format("two")), (2, "http://a.b/2", page.format("two")),
        (3, None, page.format("x")), (4, "http://a.b/3", None), (5, "http://a.b/4", ""), (None, "http://c.d/", page.format("z")),
        (6, "nonsense", "<p" * 5000), (7, "http://e.f/", "<li>item " * 20_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1)
            for c in ("host", "layout", "texts", "slot", "flags", "n_slots")})
    out = wrappers.extract(df).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r for r in out}
    assert got[1].text == "one" and got[2].text == "two" and got[1].n_template == 1
    assert got[3].text == "x\nsame" and got[None].text == "z\nsame"
    assert got[4].text is None and got[5].text == "" and got[6].text.count("<") == 5000
    assert got[7].text.count("item") == 20_000
    assert wrappers.extract(empty(df)).count() == 0


def test_ties(spark):
    """Rows that tie get results that do not follow their order or partitions."""
    words = [f"w{i}" for i in range(60)]
    variants = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in (10, 30, 50)]
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate([*variants, *variants, "a text alone in the whole table"])]
    pages = [(i, "http://h/", f"<p>{i}</p><b>{'x' * (i % 2)}</b>" if i % 3 else f"<i>{i}</i>") for i in range(6)]
    seen = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string, lang string, source string").repartition(3 if order is rows else 1)
        web = spark.createDataFrame(pages if order is rows else pages[::-1], "page_id bigint, url string, html string").repartition(2)
        rates = [(r.doc_id, round(r.rate, 9), r.copies) for r in entropy_balance.rates(docs).collect()]
        seen.append((sorted(rates), by_id(minmax_dedup.groups(docs)), by_id(wrappers.extract(web)), by_id(toxicity.scores(docs))))
    assert seen[0] == seen[1]
    assert {tuple(r) for r in minmax_dedup.groups(docs).collect()} == {(i, 0) for i in range(6)}

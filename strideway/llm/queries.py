"""Queries of the corpus operators over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_masks, context_tree, cover_tree, entropy_balance, guess_cost, minmax_dedup, token_store, toxicity, winnowing, wrappers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_balance.rates(table(spark, sf_dir, "documents"))


def op2_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guess_cost.scan(table(spark, sf_dir, "documents"))


def op3_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_masks.format_chats(table(spark, sf_dir, "conversations"))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.classes(table(spark, sf_dir, "embeddings"))


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.code_lengths(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.groups(table(spark, sf_dir, "documents"))


def op9_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.write_blocks(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_entropy_balance": op1_entropy_balance,
    "op2_guess_cost": op2_guess_cost,
    "op3_chat_masks": op3_chat_masks,
    "op4_cover_tree": op4_cover_tree,
    "op5_context_tree": op5_context_tree,
    "op6_toxicity": op6_toxicity,
    "op7_winnowing": op7_winnowing,
    "op8_minmax_dedup": op8_minmax_dedup,
    "op9_wrappers": op9_wrappers,
    "op10_token_store": op10_token_store,
}
ORACLES: dict[str, str] = {
    "op4_cover_tree": """
        WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        p AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
        r(node, label) AS (SELECT DISTINCT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL
          UNION SELECT p.b, r.label FROM r JOIN p ON p.a = r.node WHERE r.label < p.b)
        SELECT node AS vec_id, min(label) AS class_id, (SELECT count(*) FROM p WHERE p.a = node) AS links FROM r GROUP BY node""",
}

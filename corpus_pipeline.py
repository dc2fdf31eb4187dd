"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strideway.llm import common, entropy_balance, minmax_dedup, token_store, toxicity, winnowing

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose weighted toxic terms reach the threshold; rows with null or empty texts stay. Terms are learned from ``labels``, if any. An empty table gives an empty one; other columns stay."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest id; of rows that repeat an id one stays. Null ids and texts stay. An empty table gives an empty one; other columns stay."""
    return minmax_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a long span with an item of ``benchmark``; null ids and texts stay. An empty table gives an empty one; other columns stay."""
    return winnowing.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops rows so that sources and languages meet their target weights; null categories count as their own. Texts without words follow their categories. An empty table gives an empty one; other columns stay."""
    return entropy_balance.mix(docs)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stores the token ids of all rows in compressed blocks; null and empty texts are kept apart. An empty table gives no blocks."""
    return token_store.write_blocks(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_text),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_blocks", token_blocks),
]
#: Min-max hashing, Newton steps and range coding are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.saved(docs, name)
    return docs

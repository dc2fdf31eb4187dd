"""Set operations that keep multiplicity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): a ``new`` row for each surplus of a key in ``after`` and a ``resolved`` one for each in ``before``.

    Both sides are counted in one aggregation, so that only keys and counts are shuffled.
    """
    both = before.select(*key, F.lit(-1).alias("__n")).unionByName(after.select(*key, F.lit(1).alias("__n")))
    net = both.groupBy(*key).agg(F.sum("__n").cast("int").alias("__n")).where("__n <> 0")
    copies = F.explode(F.sequence(F.lit(1), F.abs("__n")))
    return net.select(*key, F.when(F.col("__n") > 0, "new").otherwise("resolved").alias("change"), copies.alias("__k")).drop("__k")


def unchanged_count(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """One row (unchanged): the rows of ``before`` that are also in ``after``, with multiplicity."""
    both = before.select(*key, F.lit(1).alias("b"),
        F.lit(0).alias("a")).unionByName(after.select(*key, F.lit(0).alias("b"), F.lit(1).alias("a")))
    return both.groupBy(*key).agg(F.least(F.sum("b"), F.sum("a")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")
        .alias("unchanged"))


def distribution_shift(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, before, after) of the keys whose counts differ."""
    both = before.select(*key, F.lit(1).alias("b"),
        F.lit(0).alias("a")).unionByName(after.select(*key, F.lit(0).alias("b"), F.lit(1).alias("a")))
    return both.groupBy(*key).agg(F.sum("b").cast("bigint").alias("before"),
        F.sum("a").cast("bigint").alias("after")).where("before <> after")


def without_common_prefix(df: DataFrame, path: str, name: str) -> DataFrame:
    """Cuts from all paths their longest common prefix that ends with a slash; it is that of the least and the greatest path."""
    ends = df.agg(F.min(path).alias("lo"), F.max(path).alias("hi"))
    same = F.expr("coalesce(array_max(filter(sequence(0, length(lo)), i -> substring(lo, 1, i) = substring(hi, 1, i))), 0)")
    cut = ends.select(F.substring("lo", F.lit(1), same.cast("int")).alias("p")).select((F.length("p") - F.instr(F.reverse("p"), "/") + 1)
        .alias("n"), F.contains("p", F.lit("/")).alias("any"))
    cut = F.broadcast(cut.select(F.when(F.col("any"), F.col("n")).otherwise(0).alias("__cut")))  # one row
    return df.crossJoin(cut).withColumn(name, F.substring(F.col(path), F.col("__cut") + 1, F.length(path))).drop("__cut")

"""Operators that rest on an order: survivors, budgets, runs, samples, ordinals.

The order must be total up to rows that are equal in the output; none of them relies on the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideway import storage


def survivors(df: DataFrame, key: list[str], order: list[Column], count: str | None = None) -> DataFrame:
    """The first row of each key; ``count`` names a column for the rows it stands for."""
    w = W.partitionBy(*key)
    out = df if count is None else df.withColumn(count, F.count("*").over(w))
    return out.withColumn("__rn", F.row_number().over(w.orderBy(*order))).where("__rn = 1").drop("__rn")


def running_budget(df: DataFrame, key: list[str], order: list[Column], limit: Column | int, running: str = "running",
    demoted: str = "demoted", counted: Column | None = None) -> DataFrame:
    """Counts the rows of a key in order; those beyond the limit are marked. Rows not ``counted`` take no part.

    All rows are sorted by key and order into ranges and written; each range counts its own rows of a key and adds those of the ranges before,
    so that a key of very many rows is never in one task.
    """
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    part = F.shiftright("__id", 33)
    sorted_ = storage.saved(df.withColumn("__one", one).orderBy(*key, *order).withColumn("__id", F.monotonically_increasing_id()),
        "ordered").withColumn("__part", part)
    before = W.partitionBy(*key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = sorted_.groupBy("__part", *key).agg(F.sum("__one").alias("__n")).withColumn("__before",
        F.coalesce(F.sum("__n").over(before), F.lit(0)))
    sums = sums.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k_{k}") for k in key), "__before")
    same = F.col("__part") == F.col("__p")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    within = W.partitionBy("__part", *key).orderBy("__id").rowsBetween(W.unboundedPreceding, 0)
    out = sorted_.withColumn("__upto", F.sum("__one").over(within)).join(storage.small(storage.saved(sums, "sums")), same)
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    out = out.withColumn(running, (F.col("__upto") + F.col("__before")).cast("bigint"))
    over = F.coalesce(F.col(running) > limit, F.lit(False))
    return out.withColumn(demoted, over & (F.col("__one") == 1)).select(*df.columns, running, demoted)


#: Bits of the rows of a chunk whose runs are numbered together.
CHUNK = 18


def islands(df: DataFrame, key: list[str], order: list[Column], same: list[str], run: str = "run") -> DataFrame:
    """Numbers the runs of rows, in order within a key, that agree in the columns ``same``."""
    w = W.partitionBy(*key).orderBy(*order)
    begins = F.lag(F.lit(1)).over(w).isNull()
    for c in same:
        begins = begins | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    return df.withColumn("__new", begins.cast("int")).withColumn(run,
        F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("bigint")).drop("__new")


def split_islands(df: DataFrame, key: list[str], seq: str, same: list[str], run: str = "run") -> DataFrame:
    """``islands`` of rows in the order of ``seq``, a ``monotonically_increasing_id``, however many rows a key has.

    Chunks of rows number their own runs; a row a chunk then says how many runs there were before it, and whether its
    first goes on with the last of the one before.
    """
    held = storage.saved(df.withColumn("__part", F.shiftright(seq, CHUNK)), "rows")
    at = ["__part", *key]
    parts = islands(held, at, [F.col(seq)], same, "__own")
    ends = held.groupBy(*at).agg(F.min_by(F.struct(*same), seq).alias("__first"), F.max_by(F.struct(*same), seq).alias("__last"))
    runs = storage.saved(parts, "runs")
    ends = ends.join(runs.groupBy(*at).agg(F.max("__own").alias("__n")), at)
    before = W.partitionBy(*key).orderBy("__part")
    goes_on = F.coalesce(F.lag("__last").over(before).eqNullSafe(F.col("__first")) & F.lag(F.lit(True)).over(before), F.lit(False))
    ends = ends.withColumn("__joined", goes_on.cast("bigint"))
    ends = ends.withColumn("__before", F.sum(F.col("__n") - F.col("__joined")).over(before.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n"))
    ends = storage.saved(ends.select(*at, "__before"), "ends")
    return runs.join(storage.small(ends), at).withColumn(run, F.col("__own") + F.col("__before")).select(*df.columns, run)


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each stratum, those with the least digest of seed, stratum and key, whatever the partitions are."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in [*strata, key])))
    return survivors_n(df.withColumn("__digest", digest), strata, [F.col("__digest"), F.col(key)], n).drop("__digest")


def survivors_n(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def _worked_out(c: Column) -> bool:
    """Whether a part of an order is an expression, neither a column of the table nor one with a direction."""
    return c._jc.node().getClass().getSimpleName() not in ("UnresolvedAttribute", "SortOrder")


def keyed(df: DataFrame, order: list[Column]) -> tuple[DataFrame, list[Column]]:
    """``df`` with a column for each expression of the order, and the order by these: a sort works an expression out again for every two rows that it compares."""
    made = {f"__by{i}": c for i, c in enumerate(order) if _worked_out(c)}
    return df.withColumns(made) if made else df, [F.col(k) if (k := f"__by{i}") in made else c for i, c in enumerate(order)]


def ordinal(df: DataFrame, order: list[Column], name: str = "ord", columns: list[str] | None = None) -> DataFrame:
    """Numbers all rows, or ``columns`` of them, from 1 by a global order without bringing them to one place.

    The rows are range-partitioned and sorted once and written; the partitions' sizes then give each its offset.
    """
    rows, by = keyed(df, order)
    sorted_ = rows.orderBy(*by).select(*(columns or df.columns), F.monotonically_increasing_id().alias("__id"))
    sorted_ = storage.saved(sorted_, "ordered")
    part = F.shiftright("__id", 33)
    sizes = {r["part"]: r["count"] for r in sorted_.groupBy(part.alias("part")).count().collect()}
    offsets, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        offsets.append(F.lit(total).cast("bigint"))
        total += sizes.get(p, 0)
    place = F.col("__id") - F.shiftleft(part, 33) + F.get(F.array(*offsets), part.cast("int")) + 1
    return sorted_.withColumn(name, place).drop("__id")

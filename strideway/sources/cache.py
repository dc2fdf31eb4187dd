"""A cache of what is worked out of units, addressed by their content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideway import storage


def content_key(*parts: Column, version: str = "1") -> Column:
    """The address of a unit: a digest of its content, dependencies, arguments and our version. Nulls and borders of parts count."""
    framed = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.md5(F.concat_ws("|", *framed, F.lit(version)))


def _there(units: DataFrame, path: str) -> bool:
    jvm, conf = units.sparkSession._jvm, units.sparkSession._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).exists(at)


def cached(units: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``compute(units)`` (with the units' ``key``), worked out only for keys that ``path`` does not hold yet; these are added to it.

    Files lie in folders by the first two digits of the key. A key without rows is looked at again each time.
    """
    spark = units.sparkSession
    folder = F.substring("key", 1, 2).alias("folder")
    wanted = storage.saved(units, "units")
    held = spark.read.parquet(path) if _there(units, path) else None
    todo = wanted if held is None else wanted.join(held.select("key").distinct(), "key", "left_anti")
    fresh = compute(todo)
    fresh.select("*", folder).write.mode("append").partitionBy("folder").parquet(path)
    return spark.read.schema(fresh.schema).parquet(path).join(wanted.select("key").distinct(), "key", "left_semi").select(fresh.columns)

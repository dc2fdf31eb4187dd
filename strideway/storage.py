"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables up to this size on disk are broadcast to a join if they are no larger than ``SENT_BYTES`` when read; larger ones are joined by shuffle.
BROADCAST_BYTES, SENT_BYTES = 32 << 20, 64 << 20
#: The like for a table that every round of a fixpoint sends again.
ROUND_BYTES = 4 << 20
#: Bytes of a row's key and place in the hash table of a broadcast, beside its values.
HASHED_ROW = 96
#: A table of no more than this on disk is not measured before it is sent.
UNMEASURED_BYTES = 256 << 10
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where a local session sets none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strideway-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return base


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, deleted when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clear)
    _WRITTEN[path] = spark
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, which cuts the lineage and survives lost executors."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that ``saved`` returned, once nothing reads it any more."""
    _delete(table.sparkSession, table._stored_at)
    _WRITTEN.pop(table._stored_at, None)


def _clear() -> None:
    """Deletes what this program wrote and has not discarded, when it ends: results may read it until then."""
    for path, spark in list(_WRITTEN.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before
            return


def stored_bytes(df: DataFrame) -> int:
    """The size on disk of a table just read from files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sent_bytes(df: DataFrame) -> int:
    """About how large a table is in memory: its texts, arrays and the like by their length, 8 bytes for anything else, and what a hashed row takes beside."""
    plain = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp")
    size = F.lit(HASHED_ROW + 8 * len(df.columns)).cast("bigint")
    for name, kind in df.dtypes:
        if kind not in plain:
            c = F.col(f"`{name}`")
            size = size + F.coalesce(F.octet_length(c if kind in ("string", "binary") else c.cast("string")), F.lit(0))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """A table just read from files, to be broadcast if its size on disk and in memory allows; else it is never broadcast.

    Without the second hint Spark would send what is little on disk, however large it gets in memory.
    """
    stored = stored_bytes(df)
    fits = stored <= UNMEASURED_BYTES or (stored <= BROADCAST_BYTES and sent_bytes(df) <= (SENT_BYTES if most is None else most))
    return F.broadcast(df) if fits else df.hint("merge")

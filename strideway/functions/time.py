"""Time as numbers, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(local: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), local.cast("timestamp_ntz"))

"""Session settings that the tests, the bench and the entry point share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "strideway", cores: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session with the options the operators rely on; a cluster sets its own master and sizes."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STRIDEWAY_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )

"""SparkSession settings used by tests, the bench and the oracle check."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "rollbook") -> SparkSession:
    """A session for tests, bench and tools; master and partitions stay as configured unless given
    (``BENCH_CPUS`` means local threads, and as many partitions)."""
    cpus = os.environ.get("BENCH_CPUS")
    b = SparkSession.builder.appName(app)
    if master or cpus:
        b = b.master(master or f"local[{cpus}]")
    if shuffle_partitions or cpus:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    b = (b
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", os.environ.get("ROLLBOOK_AQE", "true"))
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         # Remove a reliable checkpoint's files once its DataFrame is no longer referenced.
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", os.environ.get("ROLLBOOK_DRIVER_MEMORY", "16g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

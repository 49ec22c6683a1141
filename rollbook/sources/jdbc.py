"""Read the school tables from an existing MySQL database over JDBC.

Each table is read in parallel: the primary key range is split into
``partitions`` slices (one query per slice, one task each); only the
declared columns are selected, so ``users.password`` never leaves the
database; values are cast to the declared types (``class_level`` ENUM
strings become integers, TINYINT(1) flags become booleans).  The key range
comes from one ``min/max`` query per table (a single row).

Not exercised against a live database here (no server may run in this
environment); ``table_query`` and ``read_school_jdbc``'s planning are unit-tested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.sources.schema import PRIMARY_KEYS, SCHEMAS
from rollbook.sources.store import School, conform


def table_query(table: str) -> str:
    """The sub-query read for ``table``: declared columns only (no password column)."""
    cols = ", ".join(f.name for f in SCHEMAS[table].fields)
    return f"(SELECT {cols} FROM {table}) AS {table}_src"


def key_range(spark: SparkSession, url: str, table: str, properties: dict) -> tuple[int, int]:
    """(min, max) of the primary key: one single-row query."""
    pk = PRIMARY_KEYS[table]
    q = f"(SELECT MIN({pk}) AS lo, MAX({pk}) AS hi FROM {table}) AS {table}_range"
    row = spark.read.jdbc(url, q, properties=properties).first()
    lo, hi = (row.lo, row.hi) if row is not None else (None, None)
    return (int(lo) if lo is not None else 0, int(hi) if hi is not None else 0)


def read_table_jdbc(spark: SparkSession, url: str, table: str, properties: dict, partitions: int,
                    bounds: tuple[int, int] | None = None) -> DataFrame:
    lo, hi = bounds if bounds is not None else key_range(spark, url, table, properties)
    df = spark.read.jdbc(url, table_query(table), column=PRIMARY_KEYS[table], lowerBound=lo,
                         upperBound=max(hi, lo + 1), numPartitions=max(1, partitions), properties=properties)
    if "class_level" in df.columns:                       # ENUM('1'..'10') arrives as a string
        df = df.withColumn("class_level", F.col("class_level").cast("int"))
    return conform(df, table)


def read_school_jdbc(spark: SparkSession, url: str, properties: dict, partitions: dict[str, int] | None = None,
                     default_partitions: int = 8,
                     bounds: dict[str, tuple[int, int]] | None = None) -> School:
    """All 13 tables from a MySQL database (``url`` like ``jdbc:mysql://host/db``).

    ``partitions`` sets the parallel reads per table (facts need many, dimensions one);
    ``bounds`` can give known key ranges instead of the min/max queries.
    """
    partitions = partitions or {}
    bounds = bounds or {}
    return School(**{t: read_table_jdbc(spark, url, t, properties, partitions.get(t, default_partitions),
                                        bounds.get(t)) for t in SCHEMAS})

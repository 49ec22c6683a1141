"""Shared helpers: reading tables, cutting lineage, mapping texts in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.plans.dims import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{kind}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are planned inside remove their shuffle files when they end.  Else the files stay until the
    driver's memory runs low enough for a collection, and the disk holds those of many queries at once."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write to the shared folder and reread: cuts lineage, and Spark knows the size."""
    spark = df.sparkSession
    path = shared_path(spark, kind)
    with shuffles_removed(spark):
        df.select("*").write.parquet(path)  # planned anew, with the setting
    return spark.read.schema(df.schema).parquet(path)


def id_crc(col: str) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def packed(df: DataFrame) -> DataFrame:
    """The whole row as one struct ``row``, so that added columns cannot clash with it."""
    return df.select(packed_columns(df.columns))


def packed_columns(columns: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def release() -> None:
    """Hand memory that Arrow holds in reserve back at the end of a task: the worker stays."""
    pa.default_memory_pool().release_unused()


def with_scores(df: DataFrame, text: str, start: Callable[[], Callable[[list], list[pa.Array]]],
                fields: list[T.StructField]) -> DataFrame:
    """Add columns computed from the text, batch by batch.

    ``start()`` runs once in each task and returns the function from a list of texts
    (null allowed) to one Arrow array for each of ``fields``.  Result: ``row`` (the
    untouched input row) and ``fields``.
    """
    source = packed(df)
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType, False), *fields])
    names = ["row", *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = start()
        for batch in batches:
            for part in pieces_of(batch, text):
                rows = part.column(0)
                yield pa.RecordBatch.from_arrays([rows, *score(rows.field(text).to_pylist())], names)
        release()

    return source.mapInArrow(run, schema)


def pieces_of(batch: pa.RecordBatch, text: str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, at least one row."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(0).field(text)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield batch.slice(begin)

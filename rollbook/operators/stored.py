"""Changes to tables at rest that rewrite only what they touch (W8, W9), and checked writes (Q3).

Attendance is stored by month and marks by exam.  The key that a change replaces decides the
partition (a day lies in one month, a mark's key names its exam), so the partitions of a
batch are known from the batch alone: they are read, changed and written over, and files
of others stay.  One writer at a time; a change that dies before its commit leaves the
table as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.operators import changes, lifecycle
from rollbook.operators.audit import value_rules
from rollbook.plans.dims import by_key, cut_lineage
from rollbook.sources.schema import SCHEMAS
from rollbook.sources.store import LAYOUT, School, conform

PART = "part"
#: The key whose stored rows a change replaces.
KEYS = {"attendance_students": ["enrollment_id", "attendance_date"], "marks": ["enrollment_id", "subject_id", "exam_id"]}


def partition_of(table: str) -> Column:
    """attendance: the month as yyyymm; marks: the exam."""
    if table == "attendance_students":
        return (F.year("attendance_date") * 100 + F.month("attendance_date")).cast("long")
    if table == "marks":
        return F.col("exam_id").cast("long")
    raise ValueError(f"{table} is not stored by partitions")


def _laid_out(df: DataFrame, table: str) -> DataFrame:
    # A large partition is cut by its clustering columns over many tasks.
    by = [PART, *LAYOUT[table][1]]
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def write_partitioned(df: DataFrame, table: str, path: str) -> None:
    """Write a table to a fresh ``path``, by partitions."""
    _laid_out(conform(df, table).withColumn(PART, partition_of(table)), table).write.partitionBy(PART).parquet(path)


def read_partitioned(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The table with its declared columns and ``part``: a filter on it reads only those folders."""
    return spark.read.schema(T.StructType([*SCHEMAS[table].fields, T.StructField(PART, T.LongType())])).parquet(path)


def replace_rows(spark: SparkSession, table: str, path: str, rows: DataFrame) -> list[int]:
    """Store ``rows`` (checked, with ids) in place of the stored rows of their keys.

    Only partitions that hold a new row are read and written; their numbers are returned.  They are
    as many as folders of the table, which the driver lists in any case.  No rows change nothing.
    """
    key = KEYS[table]
    new = cut_lineage(conform(rows, table).withColumn(PART, partition_of(table)))
    touched = sorted(r[PART] for r in new.select(PART).distinct().collect())
    if not touched:
        return []
    old = read_partitioned(spark, table, path).where(F.col(PART).isin(touched))
    # Checkpointed: the files it comes from are about to be replaced.
    now = cut_lineage(old.join(by_key(new.select(PART, *key)), [PART, *key], "left_anti").unionByName(new))
    _laid_out(now, table).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return touched


def mark_attendance(s: School, path: str, batch: DataFrame, order_by: list[str] | None = None,
                    enforce_closed: bool = False) -> tuple[list[int], DataFrame]:
    """W8 on attendance stored below ``path``: (months written, refused rows).

    As ``changes.mark_attendance``; the stored table is read whole only for its largest id.
    """
    at = s.replace(attendance_students=read_partitioned(s.spark, "attendance_students", path).drop(PART))
    key = KEYS["attendance_students"]
    order_by = order_by or key
    rows = batch.select(*key, "status", *[c for c in order_by if c not in (*key, "status")])
    accepted, rejected = changes.append_rows(at, "attendance_students", rows, order_by, check_current=False, enforce_closed=enforce_closed)
    return replace_rows(s.spark, "attendance_students", path, accepted), rejected


def add_marks(s: School, path: str, batch: DataFrame, enforce_closed: bool = False) -> tuple[School, list[int], DataFrame]:
    """W9 on marks stored below ``path``: (school with its new exams, exams written, refused rows)."""
    at = s.replace(marks=read_partitioned(s.spark, "marks", path).drop(PART))
    changed, accepted, rejected = lifecycle.add_marks(at, batch, enforce_closed=enforce_closed)
    touched = replace_rows(s.spark, "marks", path, accepted)
    return changed.replace(marks=read_partitioned(s.spark, "marks", path).drop(PART)), touched, rejected


def write_observed(df: DataFrame, table: str, path: str) -> DataFrame:
    """Write ``df`` to a fresh ``path`` and return what ``audit_values`` says of it, counted as
    the rows pass into the file: no second scan.  An empty table breaks no rule."""
    rules = value_rules(table)
    seen = Observation()
    df.observe(seen, *[F.count_if(broken).alias(f"r{i}") for i, (_, _, broken) in enumerate(rules)]).write.parquet(path)
    counts = seen.get
    return df.sparkSession.createDataFrame([(table, f"{rule}:{col}", int(counts.get(f"r{i}") or 0)) for i, (rule, col, _) in enumerate(rules)],
                                           "table_name string, rule string, violations long")

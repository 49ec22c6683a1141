"""The set of school tables as DataFrames, and their Parquet layout.

``School`` is an immutable record of the 13 tables.  Operators take a
``School`` and return a DataFrame (reports) or a new ``School`` /
DataFrame (table changes); nothing is collected to the driver.

Layout at rest (``write_school``): enrollments are partitioned by academic
year, so the active-year semi-join prunes the other years' directories
(dynamic partition pruning); marks, attendance and assignments are sorted
by ``enrollment_id`` inside files and payments by ``payment_date``, so
Parquet row-group min/max statistics skip data for key and date filters.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.sources.schema import SCHEMAS


@dataclasses.dataclass(frozen=True)
class School:
    academic_years: DataFrame
    users: DataFrame
    employees: DataFrame
    classes: DataFrame
    student_master: DataFrame
    student_enrollments: DataFrame
    subjects: DataFrame
    exams: DataFrame
    marks: DataFrame
    attendance_students: DataFrame
    fee_structures: DataFrame
    student_fee_assignments: DataFrame
    fee_payments: DataFrame

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def replace(self, **tables: DataFrame) -> "School":
        return dataclasses.replace(self, **tables)

    @property
    def spark(self) -> SparkSession:
        return self.academic_years.sparkSession


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project and cast ``df`` to the declared columns of ``table`` (absent columns become NULL)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in SCHEMAS[table].fields])


# How each table is laid out when written: (partition columns, sort-within-files columns).
LAYOUT: dict[str, tuple[list[str], list[str]]] = {
    "student_enrollments": (["academic_year_id"], ["class_id", "enrollment_id"]),
    "marks": ([], ["enrollment_id"]),
    "attendance_students": ([], ["attendance_date", "enrollment_id"]),
    "student_fee_assignments": ([], ["enrollment_id"]),
    "fee_payments": ([], ["payment_date", "enrollment_id"]),
    "student_master": ([], ["student_master_id"]),
}


def write_school(school: School, path: str, mode: str = "overwrite", files_per_table: int | None = None) -> None:
    """Write every table under ``path/<table>`` as Parquet with the layout above.

    Tables with a layout are range-partitioned on (partition columns, clustering
    columns) before the write: tasks get balanced, contiguous key ranges (a large
    year is split over many tasks, never one), each file covers a narrow key range
    so row-group min/max statistics prune, and each task writes into one or two
    partition directories instead of all of them.  Without ``files_per_table`` Spark
    merges ranges to its advisory partition size, so the number of files follows the data.
    A folder that the school itself is read from is refused: writing would destroy it.
    """
    target = path.rstrip("/").removeprefix("file:").replace("//", "/")
    for name in SCHEMAS:
        if any(f"{target}/" in f.removeprefix("file:").replace("//", "/") for f in school.table(name).inputFiles()):
            raise ValueError(f"{path} holds the files that table {name} is read from")
    for name in SCHEMAS:
        df = school.table(name)
        parts, sort_cols = LAYOUT.get(name, ([], []))
        if parts or sort_cols:
            by = [*parts, *sort_cols]
            df = df.repartitionByRange(*([files_per_table] if files_per_table else []), *by).sortWithinPartitions(*by)
        writer = df.write.mode(mode)
        if parts:
            writer = writer.partitionBy(*parts)
        writer.parquet(f"{path}/{name}")


def read_school(spark: SparkSession, path: str) -> School:
    """Read the tables written by ``write_school`` with their declared schemas."""
    tables = {}
    for name, schema in SCHEMAS.items():
        # Declared schema on read: partition columns keep their declared types (no inference).
        df = spark.read.schema(schema).parquet(f"{path}/{name}")
        tables[name] = conform(df, name)
    return School(**tables)

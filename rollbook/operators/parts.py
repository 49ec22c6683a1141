"""Distinct counts that add up (R5, R16, R24, R27): bitmaps of ids as stored parts.

A part is the set of ids of one group, as one bitmap of 4 KB for each 32,768 ids in use.
Parts of finer groups (a class and a month) merge into those of coarser ones (a class, a
teacher) by OR, so that a year's distinct count comes from parts and not from the facts, and a
new month only adds its own.  Worth storing where groups hold many ids that lie close
together: a group of a few scattered ids is smaller as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.plans.dims import by_key
from rollbook.sources.store import School


def id_parts(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """keys, bucket, ids: the different non-null ids of each group (keys may be null)."""
    return (rows.where(F.col(id_col).isNotNull()).groupBy(*keys, F.bitmap_bucket_number(id_col).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(id_col)).alias("ids")))


def merge_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of the groups ``keys``, each the union of the parts that fall in it."""
    return parts.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("ids").alias("ids"))


def count_parts(parts: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """keys and the number of different ids of each group; parts may overlap."""
    return merge_parts(parts, keys).groupBy(*keys).agg(F.sum(F.bitmap_count("ids")).alias(name))


def attendance_parts(s: School) -> DataFrame:
    """Enrollments with attendance, per class, year and month."""
    enr = s.student_enrollments.select("enrollment_id", "class_id", "academic_year_id")
    month = (F.year("attendance_date") * 100 + F.month("attendance_date")).alias("month")
    return id_parts(s.attendance_students.select("enrollment_id", month).join(by_key(enr), "enrollment_id"),
                    ["academic_year_id", "class_id", "month"], "enrollment_id")


def subject_parts(s: School) -> DataFrame:
    """Subjects with marks, per class and exam."""
    enr = s.student_enrollments.select("enrollment_id", "class_id")
    return id_parts(s.marks.select("enrollment_id", "subject_id", "exam_id").join(by_key(enr), "enrollment_id"), ["class_id", "exam_id"], "subject_id")


def student_parts(s: School) -> DataFrame:
    """Students, per class and year."""
    return id_parts(s.student_enrollments, ["academic_year_id", "class_id"], "student_master_id")


def teacher_students(s: School, parts: DataFrame) -> DataFrame:
    """teacher_id, students: different students over all classes and years that a teacher teaches,
    each once though taught in many, from the parts of the classes."""
    pairs = s.subjects.where("teacher_id is not null").select("teacher_id", "class_id").distinct()
    return count_parts(parts.join(pairs, "class_id"), ["teacher_id"], "students")

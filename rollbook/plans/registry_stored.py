"""Registered distinct counts from stored parts, with DuckDB oracles that count all rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rollbook.catalog import register
from rollbook.operators import parts
from rollbook.plans.dims import fresh_folder


# Distinct counts from parts, written first and merged as they are read again.
def _kept(df: DataFrame) -> DataFrame:
    path = fresh_folder(df.sparkSession, "parts")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


register("attending_by_class_and_year", """
SELECT academic_year_id, class_id, count(DISTINCT enrollment_id) AS students
  FROM attendance_students JOIN student_enrollments USING (enrollment_id) GROUP BY academic_year_id, class_id
""")(lambda s: parts.count_parts(_kept(parts.attendance_parts(s)), ["academic_year_id", "class_id"], "students"))

register("attending_by_month", """
SELECT CAST(year(attendance_date) * 100 + month(attendance_date) AS INTEGER) AS month, count(DISTINCT enrollment_id) AS students
  FROM attendance_students JOIN student_enrollments USING (enrollment_id) GROUP BY 1
""")(lambda s: parts.count_parts(_kept(parts.attendance_parts(s)), ["month"], "students"))

register("subjects_marked_by_class", """
SELECT class_id, count(DISTINCT subject_id) AS subjects FROM marks JOIN student_enrollments USING (enrollment_id) GROUP BY class_id
""")(lambda s: parts.count_parts(_kept(parts.subject_parts(s)), ["class_id"], "subjects"))

register("students_by_teacher", """
SELECT teacher_id, count(DISTINCT student_master_id) AS students
  FROM subjects JOIN student_enrollments USING (class_id) WHERE teacher_id IS NOT NULL GROUP BY teacher_id
""")(lambda s: parts.teacher_students(s, _kept(parts.student_parts(s))))

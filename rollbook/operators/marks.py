"""Marks, attendance and classroom reports.

Marks and attendance are reduced per enrollment (or per enrollment and
exam) before any join; per-class and per-teacher dimensions are broadcast
only behind the size check of ``rollbook.plans.dims``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.exprs import full_name, grade, percentage
from rollbook.operators.common import (
    of_enrollments,
    classes_dim, employees_dim, exams_dim, subjects_dim, with_student, years_dim)
from rollbook.plans.dims import by_key, in_active_year, restrict
from rollbook.sources.store import School


def _class_filter(df: DataFrame, class_id: int | None) -> DataFrame:
    return df if class_id is None else df.where(F.col("class_id") == F.lit(class_id))


def _marks_per_enrollment(s: School, only: DataFrame) -> DataFrame:
    return of_enrollments(s.marks, only).groupBy("enrollment_id").agg(
        F.countDistinct("subject_id").alias("total_subjects"),
        F.sum("marks_obtained").alias("total_marks_obtained"),
        F.sum("max_marks").alias("total_max_marks"))


def _scored(s: School, class_id: int | None) -> DataFrame:
    enr = _class_filter(in_active_year(s.student_enrollments, s.academic_years), class_id)
    # Inner join: an enrollment without marks rows has no distinct subject (HAVING count > 0).
    x = enr.select("enrollment_id", "student_master_id", "class_id", "roll_no").join(
        by_key(_marks_per_enrollment(s, enr)), "enrollment_id", "inner")
    x = with_student(x, s, "reg_no", "fname", "lname")
    return x.withColumn("percentage", percentage("total_marks_obtained", "total_max_marks"))


def class_performance(s: School, class_id: int | None = None) -> DataFrame:
    """Per active-year student with marks rows: subjects, totals, percentage; best first."""
    return (_scored(s, class_id)
            .select("class_id", "enrollment_id", full_name("fname", "lname").alias("student_name"),
                    "roll_no", "reg_no", "total_subjects", "total_marks_obtained", "total_max_marks",
                    "percentage")
            .orderBy("class_id", F.desc("percentage"), "enrollment_id"))


def top_students(s: School, class_id: int | None = None, n: int = 10) -> DataFrame:
    """The n best students of each class (ties broken by enrollment id).

    ``row_number() <= n`` per class is planned with a partial per-partition
    limit before the shuffle, so a large class never travels whole.
    """
    x = _scored(s, class_id).where(F.col("total_marks_obtained").isNotNull())
    w = Window.partitionBy("class_id").orderBy(F.desc("percentage"), F.asc("enrollment_id"))
    return (x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("class_id", "rank", "enrollment_id", full_name("fname", "lname").alias("student_name"),
                    "roll_no", "total_marks_obtained", "total_max_marks", "percentage")
            .orderBy("class_id", "rank"))


def progress_report(s: School, keys: DataFrame | None = None) -> DataFrame:
    """Per enrollment and exam: distinct subjects, totals, percentage."""
    m = restrict(s.marks, keys, "enrollment_id")
    agg = m.groupBy("enrollment_id", "exam_id").agg(
        F.countDistinct("subject_id").alias("subjects_count"),
        F.sum("marks_obtained").alias("total_obtained"), F.sum("max_marks").alias("total_max"))
    return (agg.join(exams_dim(s, "exam_name"), "exam_id")
            .select("enrollment_id", "exam_id", "exam_name", "subjects_count", "total_obtained", "total_max",
                    percentage("total_obtained", "total_max").alias("percentage"))
            .orderBy("enrollment_id", "exam_name", "exam_id"))


def marks_sheet(s: School, keys: DataFrame | None = None) -> DataFrame:
    """Every mark with subject and exam names (two broadcast lookups, no shuffle)."""
    m = restrict(s.marks, keys, "enrollment_id")
    return (m.join(subjects_dim(s, "subject_name"), "subject_id")
            .join(exams_dim(s, "exam_name"), "exam_id")
            .select("enrollment_id", "mark_id", "subject_name", "exam_name", "marks_obtained", "max_marks",
                    "grade")
            .orderBy("enrollment_id", "exam_name", "subject_name", "mark_id"))


def regrade(s: School) -> DataFrame:
    """R20 applied to the marks table: the grade recomputed from marks and maximum."""
    return s.marks.select("mark_id", "marks_obtained", "max_marks",
                          grade("marks_obtained", "max_marks").alias("grade"))


def attendance_month(s: School, year: int | None = None, month: int | None = None,
                     keys: DataFrame | None = None) -> DataFrame:
    """Per enrollment and month: total, present and absent days plus the day records.

    ``records`` is the month's (date, status) list in date order; a month
    holds at most 31 records per enrollment (unique enrollment/date).
    """
    a = restrict(s.attendance_students, keys, "enrollment_id")
    if year is not None:
        # Half-open date ranges rather than YEAR()/MONTH() = …, so the filter reaches the scan.
        if month is None:
            lo, hi = dt.date(year, 1, 1), dt.date(year + 1, 1, 1)
        else:
            lo, hi = dt.date(year, month, 1), dt.date(year + (month == 12), month % 12 + 1, 1)
        a = a.where((F.col("attendance_date") >= F.lit(lo)) & (F.col("attendance_date") < F.lit(hi)))
    elif month is not None:
        a = a.where(F.month("attendance_date") == F.lit(month))
    present = (F.col("status") == "Present").cast("int")
    return (a.groupBy("enrollment_id", F.year("attendance_date").alias("year"),
                      F.month("attendance_date").alias("month"))
            .agg(F.count(F.lit(1)).alias("total_days"), F.sum(present).cast("long").alias("present_days"),
                 F.array_sort(F.collect_list(F.struct("attendance_date", "status"))).alias("records"))
            .withColumn("absent_days", F.col("total_days") - F.col("present_days"))
            .select("enrollment_id", "year", "month", "total_days", "present_days", "absent_days", "records"))


def class_attendance(s: School, class_id: int | None = None, date=None) -> DataFrame:
    """Attendance of a class on a day (or every class and day), in roll order."""
    a = s.attendance_students
    if date is not None:
        a = a.where(F.col("attendance_date") == F.lit(date))
    enr = _class_filter(s.student_enrollments, class_id).select(
        "enrollment_id", "student_master_id", "class_id", "roll_no")
    x = with_student(a.join(by_key(enr), "enrollment_id"), s, "fname", "lname")
    return (x.select("class_id", "attendance_date", "attendance_id", "enrollment_id", "status", "fname",
                     "lname", "roll_no")
            .orderBy("class_id", "attendance_date", "roll_no"))


def _class_subject_names(s: School) -> DataFrame:
    """Per (class, year): the subject names, sorted (a class has a handful of subjects)."""
    return (s.subjects.groupBy("class_id", "academic_year_id")
            .agg(F.array_sort(F.collect_list("subject_name")).alias("subjects")))


def student_dashboard(s: School, keys: DataFrame | None = None) -> DataFrame:
    """Per active enrollment: class, class teacher, days, present days, subject names.

    The reference's correlated scalar subqueries become per-enrollment
    pre-aggregates joined back (0 for no attendance, NULL for no subject).
    """
    enr = in_active_year(s.student_enrollments, s.academic_years).where(F.col("user_id").isNotNull())
    enr = restrict(enr, keys, "user_id")
    att = of_enrollments(s.attendance_students, enr).groupBy("enrollment_id").agg(
        F.count(F.lit(1)).alias("total_days"),
        F.sum((F.col("status") == "Present").cast("long")).alias("present_days"))
    teacher = employees_dim(s, "fname", "lname").withColumnRenamed("employee_id", "class_teacher_id")
    x = (enr.select("enrollment_id", "user_id", "roll_no", "class_id", "academic_year_id")
         .join(classes_dim(s, "class_level", "division", "class_teacher_id"), "class_id")
         .join(teacher, "class_teacher_id", "left")
         .join(years_dim(s, "year_name"), "academic_year_id")
         .join(by_key(att), "enrollment_id", "left")
         .join(_class_subject_names(s), ["class_id", "academic_year_id"], "left"))
    return x.select("enrollment_id", "user_id", "roll_no", "class_level", "division", "year_name",
                    full_name("fname", "lname").alias("class_teacher"),
                    F.coalesce("total_days", F.lit(0)).alias("total_days"),
                    F.coalesce("present_days", F.lit(0)).alias("present_days"), "subjects")


def _teacher_classes(s: School) -> DataFrame:
    """Distinct (teacher, class) pairs from subjects (small: bounded by the subjects table)."""
    return s.subjects.select("teacher_id", "class_id").distinct()


def _class_sizes(s: School) -> DataFrame:
    return s.student_enrollments.groupBy("class_id").agg(F.count(F.lit(1)).alias("student_count"))


def teacher_classes(s: School, keys: DataFrame | None = None) -> DataFrame:
    """Per teacher (user): active-year classes taught and each class's student count."""
    emp = restrict(s.employees.select("employee_id", "user_id"), keys, "user_id")
    active_classes = in_active_year(s.classes, s.academic_years).select(
        "class_id", "class_level", "division", "academic_year_id")
    pairs = (_teacher_classes(s).join(emp.withColumnRenamed("employee_id", "teacher_id"),
                                      "teacher_id")
             .join(active_classes, "class_id"))
    return (pairs.join(years_dim(s, "year_name"), "academic_year_id")
            .join(_class_sizes(s), "class_id", "left")
            .select("user_id", "class_id", "class_level", "division", "year_name",
                    F.coalesce("student_count", F.lit(0)).alias("student_count"))
            .orderBy("user_id", "class_level", "division", "class_id"))


def teacher_subjects(s: School, keys: DataFrame | None = None) -> DataFrame:
    """Per teacher (user): the active-year subjects they teach."""
    emp = restrict(s.employees.select("employee_id", "user_id"), keys, "user_id")
    sub = in_active_year(s.subjects, s.academic_years)
    return (sub.join(emp.withColumnRenamed("employee_id", "teacher_id"), "teacher_id")
            .join(classes_dim(s, "class_level", "division"), "class_id")
            .join(years_dim(s, "year_name"), "academic_year_id")
            .select("user_id", "subject_id", "subject_name", "class_id", "class_level", "division", "year_name")
            .orderBy("user_id", "class_level", "division", "subject_name", "subject_id"))


def class_students(s: School, class_id: int | None = None) -> DataFrame:
    """Active-year roster of a class (or all classes) in roll order."""
    enr = _class_filter(in_active_year(s.student_enrollments, s.academic_years), class_id)
    x = with_student(enr.select("enrollment_id", "student_master_id", "class_id", "roll_no"), s,
                     "fname", "lname", "gender", "reg_no")
    return (x.select("class_id", "enrollment_id", "roll_no", "student_master_id", "fname", "lname", "gender",
                     "reg_no")
            .orderBy("class_id", "roll_no"))


def teacher_dashboard(s: School, keys: DataFrame | None = None) -> DataFrame:
    """Per employee: distinct active classes, active subjects, distinct active students."""
    emp = restrict(s.employees.select("employee_id", "user_id"), keys, "user_id")
    pairs = _teacher_classes(s)
    active_cls = in_active_year(s.classes, s.academic_years).select("class_id")
    n_classes = (pairs.join(active_cls, "class_id", "left_semi")
                 .groupBy("teacher_id").agg(F.count(F.lit(1)).alias("total_classes")))
    n_subjects = (in_active_year(s.subjects, s.academic_years)
                  .groupBy("teacher_id").agg(F.count(F.lit(1)).alias("total_subjects")))
    # Active enrollments are counted for each class, then summed over each teacher's classes.
    heads = (in_active_year(s.student_enrollments, s.academic_years)
             .groupBy("class_id").agg(F.count(F.lit(1)).alias("heads")))
    n_students = heads.join(pairs, "class_id").groupBy("teacher_id").agg(F.sum("heads").alias("total_students"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (emp.withColumnRenamed("employee_id", "teacher_id")
            .join(n_classes, "teacher_id", "left").join(n_subjects, "teacher_id", "left")
            .join(n_students, "teacher_id", "left")
            .select(F.col("teacher_id").alias("employee_id"), "user_id", zero("total_classes"),
                    zero("total_subjects"), zero("total_students")))


def records_text(records: Column) -> Column:
    """Render an attendance record list as 'yyyy-MM-dd:Status,…' (for cross-engine comparison)."""
    return F.array_join(F.transform(records, lambda r: F.concat(
        F.date_format(r["attendance_date"], "yyyy-MM-dd"), F.lit(":"), r["status"])), ",")

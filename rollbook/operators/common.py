"""Building blocks shared by the reports.

Fact tables (payments, marks, attendance, assignments) are reduced to one row per
join key before they are joined.  Reports of some enrollments (one year, one class,
given keys) first keep only their facts with a semi-join: Spark turns the wanted ids
into a runtime filter of the scan where that pays, and the aggregate and the joins
behind it reuse the partitioning by enrollment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators.totals import FeeTotals
from rollbook.plans.dims import by_key
from rollbook.sources.store import School


def of_enrollments(facts: DataFrame, only: DataFrame | None) -> DataFrame:
    """The facts of the enrollments in ``only`` (``None`` = all)."""
    return facts if only is None else by_key(facts.join(by_key(only.select("enrollment_id")), "enrollment_id", "left_semi"))


def paid_by_enrollment(s: School, only: DataFrame | None = None, totals: FeeTotals | None = None) -> DataFrame:
    """enrollment_id, paid, n_payments — one row per enrollment with payments."""
    if totals is not None:
        return by_key(of_enrollments(totals.paid, only))
    return by_key(of_enrollments(s.fee_payments.select("enrollment_id", "amount_paid"), only).groupBy("enrollment_id")
            .agg(F.sum("amount_paid").alias("paid"), F.count(F.lit(1)).alias("n_payments")))


def assignments_by_amount(s: School, only: DataFrame | None = None, totals: FeeTotals | None = None) -> DataFrame:
    """enrollment_id, total_amount, n_copies — equal assignments of one enrollment merged."""
    if totals is not None:
        return by_key(of_enrollments(totals.assigned, only))
    return by_key(of_enrollments(s.student_fee_assignments.select("enrollment_id", "total_amount"), only)
            .groupBy("enrollment_id", "total_amount").agg(F.count(F.lit(1)).alias("n_copies")))


def assignments_by_enrollment(s: School, only: DataFrame | None = None, totals: FeeTotals | None = None) -> DataFrame:
    """enrollment_id, fee, n_assign — all assignments of an enrollment summed."""
    if totals is not None:
        return by_key(of_enrollments(totals.assigned, only).groupBy("enrollment_id")
                .agg(F.sum(F.col("total_amount") * F.col("n_copies")).cast("decimal(20,2)").alias("fee"), F.sum("n_copies").alias("n_assign")))
    return by_key(of_enrollments(s.student_fee_assignments.select("enrollment_id", "total_amount"), only).groupBy("enrollment_id")
            .agg(F.sum("total_amount").alias("fee"), F.count(F.lit(1)).alias("n_assign")))


def classes_dim(s: School, *cols: str) -> DataFrame:
    return F.broadcast(s.classes.select("class_id", *cols))


def years_dim(s: School, *cols: str) -> DataFrame:
    return F.broadcast(s.academic_years.select("academic_year_id", *cols))


def employees_dim(s: School, *cols: str) -> DataFrame:
    return s.employees.select("employee_id", *cols)


def subjects_dim(s: School, *cols: str) -> DataFrame:
    return s.subjects.select("subject_id", *cols)


def exams_dim(s: School, *cols: str) -> DataFrame:
    return s.exams.select("exam_id", *cols)


def with_student(df: DataFrame, s: School, *cols: str) -> DataFrame:
    """Attach student_master columns (a shuffle join: students grow with the data)."""
    return df.join(by_key(s.student_master.select("student_master_id", *cols)), "student_master_id", "inner")

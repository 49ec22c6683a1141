"""Fee reports.

The reference joins assignments and payments on the enrollment and sums
over the join, so a payment is counted once per assignment copy and a fee
once per payment (join fan-out).  Here each side is pre-aggregated per
enrollment and the fan-out is reproduced arithmetically where the
reference's meaning needs it (``n_copies * paid``), never materialised.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.exprs import full_name, full_name_strict, zero_if_null
from rollbook.operators.common import (
    assignments_by_amount, assignments_by_enrollment, classes_dim, paid_by_enrollment,
    with_student, years_dim)
from rollbook.operators.totals import FeeTotals
from rollbook.plans.dims import by_key, in_active_year, restrict
from rollbook.sources.store import School


def wanted_ids(keys: DataFrame | None) -> DataFrame | None:
    return None if keys is None else keys.select("enrollment_id").distinct()


def _year_filter(df: DataFrame, year: int | None, col: str = "academic_year_id") -> DataFrame:
    return df if year is None else df.where(F.col(col) == F.lit(year))


def fee_status(s: School, totals: FeeTotals | None = None) -> DataFrame:
    """Every active-year enrollment with assigned (0 if none), paid and pending.

    One row per (enrollment, distinct assigned amount); payments count once
    per assignment copy of that amount, as in the reference's grouped join.
    With ``totals`` neither payments nor assignments are read.
    """
    enr = in_active_year(s.student_enrollments, s.academic_years)
    paid = paid_by_enrollment(s, enr, totals)
    x = (enr.select("enrollment_id", "student_master_id", "roll_no", "class_id", "academic_year_id")
         .join(assignments_by_amount(s, enr, totals), "enrollment_id", "left")
         .join(paid, "enrollment_id", "left"))
    x = with_student(x, s, "reg_no", "fname", "lname", "mobile")
    x = x.join(classes_dim(s, "class_level", "division"), "class_id").join(years_dim(s, "year_name"),
                                                                           "academic_year_id")
    total = zero_if_null("total_amount")
    total_paid = zero_if_null(F.col("paid") * F.coalesce(F.col("n_copies"), F.lit(1)))
    return (x.select("enrollment_id", "student_master_id", "reg_no",
                     full_name("fname", "lname").alias("student_name"), "roll_no", "class_level",
                     "division", "mobile", "year_name", total.alias("total_amount"),
                     total_paid.alias("total_paid"), (total - total_paid).alias("total_pending"))
            .orderBy("class_level", "division", "roll_no", "enrollment_id"))


def _assigned_vs_paid(s: School, enr: DataFrame, some: bool) -> DataFrame:
    """Per (enrollment, assigned amount) of ``enr``: total_amount, paid, pending (inner on assignments).

    ``some``: ``enr`` is a part of all enrollments, so facts are kept to it first.
    """
    only = enr if some else None
    x = (enr.join(assignments_by_amount(s, only), "enrollment_id", "inner")
         .join(paid_by_enrollment(s, only), "enrollment_id", "left"))
    paid = zero_if_null(F.col("paid") * F.col("n_copies"))
    return (x.withColumn("total_paid", paid)
            .withColumn("pending_amount", F.col("total_amount") - F.col("total_paid")))


def defaulters(s: School) -> DataFrame:
    """R2: active-year assignments with pending > 0, largest pending first."""
    enr = in_active_year(s.student_enrollments, s.academic_years).select(
        "enrollment_id", "student_master_id", "roll_no", "class_id")
    x = _assigned_vs_paid(s, enr, True).where(F.col("pending_amount") > 0)
    x = with_student(x, s, "reg_no", "fname", "lname", "mobile").join(
        classes_dim(s, "class_level", "division"), "class_id")
    return (x.select("enrollment_id", full_name("fname", "lname").alias("student_name"), "reg_no",
                     "roll_no", "class_level", "division", "mobile", "total_amount", "total_paid",
                     "pending_amount")
            .orderBy(F.desc("pending_amount"), "enrollment_id"))


def defaulters_by_year(s: School, year: int | None = None) -> DataFrame:
    """As R2 for one year (or every year); NULL-propagating name; sorted by class."""
    enr = _year_filter(s.student_enrollments, year).select(
        "enrollment_id", "student_master_id", "class_id", "academic_year_id")
    x = _assigned_vs_paid(s, enr, year is not None).where(F.col("pending_amount") > 0)
    x = with_student(x, s, "reg_no", "fname", "lname").join(classes_dim(s, "class_level", "division"),
                                                             "class_id")
    return (x.select("academic_year_id", "enrollment_id", "reg_no",
                     full_name_strict("fname", "lname").alias("name"), "class_level", "division",
                     "total_amount", F.col("total_paid").alias("paid"),
                     F.col("pending_amount").alias("pending"))
            .orderBy("academic_year_id", "class_level", "division", "enrollment_id"))


def fee_class_report(s: School, class_id: int | None = None, year: int | None = None) -> DataFrame:
    """Per student of a class (or of every class): assigned, paid, pending; sorted by reg_no."""
    enr = _year_filter(s.student_enrollments, year)
    if class_id is not None:
        enr = enr.where(F.col("class_id") == F.lit(class_id))
    enr = enr.select("enrollment_id", "student_master_id", "class_id", "academic_year_id")
    x = with_student(_assigned_vs_paid(s, enr, year is not None or class_id is not None), s, "reg_no", "fname", "lname")
    return (x.select("class_id", "academic_year_id", "enrollment_id", "reg_no",
                     full_name_strict("fname", "lname").alias("name"), "total_amount",
                     F.col("total_paid").alias("paid"), F.col("pending_amount").alias("pending"))
            .orderBy("class_id", "reg_no", "enrollment_id"))


def class_wise_fees(s: School) -> DataFrame:
    """Per active-year class: students, fees, collected (once per assignment copy), pending."""
    enr = in_active_year(s.student_enrollments, s.academic_years).select("enrollment_id", "class_id")
    per_enr = (enr.join(assignments_by_enrollment(s, enr), "enrollment_id", "left")
               .join(paid_by_enrollment(s, enr), "enrollment_id", "left")
               .select("class_id", "enrollment_id", "fee",
                       (zero_if_null("paid") * F.coalesce(F.col("n_assign"), F.lit(1))).alias("collected")))
    per_class = per_enr.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("total_students"), F.sum("fee").alias("total_fee"),
        F.sum("collected").alias("total_collected"))
    return (per_class.join(classes_dim(s, "class_level", "division"), "class_id")
            .select("class_id", "class_level", "division", "total_students", "total_fee", "total_collected",
                    (F.col("total_fee") - F.col("total_collected")).alias("total_pending"))
            .orderBy("class_level", "division", "class_id"))


def fee_balance(s: School, keys: DataFrame | None = None, with_default: bool = False) -> DataFrame:
    """Per assignment: total, paid (all payments of its enrollment), balance, assigned date.

    ``with_default`` adds a 0/0/0 row for each wanted enrollment without an assignment
    (``keys`` gives the wanted enrollments; by default every enrollment).
    """
    asg = restrict(s.student_fee_assignments, keys, "enrollment_id")
    x = asg.join(paid_by_enrollment(s, wanted_ids(keys)), "enrollment_id", "left")
    out = x.select("assignment_id", "enrollment_id", "total_amount",
                   zero_if_null("paid").alias("total_paid"),
                   (F.col("total_amount") - zero_if_null("paid")).alias("balance"), "assigned_date")
    if not with_default:
        return out
    wanted = restrict(s.student_enrollments, keys, "enrollment_id").select("enrollment_id")
    zero = F.lit(0).cast("decimal(10,2)")
    missing = (wanted.join(by_key(asg.select("enrollment_id")), "enrollment_id", "left_anti")
               .select(F.lit(None).cast("long").alias("assignment_id"), "enrollment_id",
                       zero.alias("total_amount"), zero.alias("total_paid"), zero.alias("balance"),
                       F.lit(None).cast("date").alias("assigned_date")))
    return out.unionByName(missing)


def fee_status_by_total(s: School, keys: DataFrame | None = None) -> DataFrame:
    """Per (enrollment, assigned amount): equal copies merged, payments counted per copy."""
    asg = assignments_by_amount(s, wanted_ids(keys))
    x = asg.join(paid_by_enrollment(s, wanted_ids(keys)), "enrollment_id", "left")
    paid = zero_if_null(F.col("paid") * F.col("n_copies"))
    return x.select("enrollment_id", "total_amount", paid.alias("paid"),
                    (F.col("total_amount") - paid).alias("pending"))


def fee_summary(s: School, year: int | None = None, totals: FeeTotals | None = None) -> DataFrame:
    """R8 (exact): per year, Σ assigned fees, Σ payments of enrollments with an assignment, pending."""
    enr = _year_filter(s.student_enrollments, year).select("enrollment_id", "academic_year_id")
    only = None if year is None else enr
    per_enr = (enr.join(assignments_by_enrollment(s, only, totals), "enrollment_id", "inner")
               .join(paid_by_enrollment(s, only, totals), "enrollment_id", "left"))
    agg = per_enr.groupBy("academic_year_id").agg(
        F.sum("fee").alias("total_fees"), zero_if_null(F.sum("paid")).alias("collected"))
    return agg.select("academic_year_id", "total_fees", "collected",
                      (F.col("total_fees") - F.col("collected")).alias("pending"))


def fee_summary_as_written(s: School, year: int | None = None, totals: FeeTotals | None = None) -> DataFrame:
    """R8 (parity): the reference's single fan-out join, reproduced arithmetically.

    Each fee counts once per payment of its enrollment, each payment once per
    assignment; collected is NULL when no enrollment has a payment.
    """
    enr = _year_filter(s.student_enrollments, year).select("enrollment_id", "academic_year_id")
    only = None if year is None else enr
    per_enr = (enr.join(assignments_by_enrollment(s, only, totals), "enrollment_id", "inner")
               .join(paid_by_enrollment(s, only, totals), "enrollment_id", "left"))
    fees = F.col("fee") * F.greatest(F.coalesce(F.col("n_payments"), F.lit(0)), F.lit(1))
    coll = F.col("paid") * F.col("n_assign")
    agg = per_enr.groupBy("academic_year_id").agg(F.sum(fees).alias("total_fees"),
                                                  F.sum(coll).alias("collected"))
    return agg.select("academic_year_id", F.col("total_fees").cast("decimal(38,2)").alias("total_fees"),
                      F.col("collected").cast("decimal(38,2)").alias("collected"),
                      (F.col("total_fees") - F.col("collected")).cast("decimal(38,2)").alias("pending"))


def fee_structure(s: School, year: int | None = None) -> DataFrame:
    """Level → amount for a year (or all years), sorted by level."""
    return (_year_filter(s.fee_structures, year)
            .select("academic_year_id", "class_level", "total_amount")
            .orderBy("academic_year_id", "class_level"))


def payment_history(s: School, keys: DataFrame | None = None, newest_first: bool = True,
                    brief: bool = False) -> DataFrame:
    """Payments per enrollment, newest first (or oldest first with fewer columns)."""
    p = restrict(s.fee_payments, keys, "enrollment_id")
    date_order = F.desc("payment_date") if newest_first else F.asc("payment_date")
    cols = ["enrollment_id", "amount_paid", "payment_date", "payment_mode", "receipt_no"]
    if not brief:
        cols = ["payment_id"] + cols
    return p.select(*cols).orderBy("enrollment_id", date_order, *(["payment_id"] if not brief else []))


def recent_transactions(s: School, n: int = 50) -> DataFrame:
    """The n latest payments (date desc, id desc) with student and class.

    Payments without an enrollment, student or class are not listed, so the joins come
    first; the top n is then taken in each partition and merged.
    """
    enr = s.student_enrollments.select("enrollment_id", "student_master_id", "class_id")
    students = s.student_master.select("student_master_id", "reg_no", "fname", "lname")
    x = (s.fee_payments.select("payment_id", "enrollment_id", "amount_paid", "payment_date", "payment_mode", "receipt_no")
         .join(by_key(enr), "enrollment_id").join(by_key(students), "student_master_id").join(classes_dim(s, "class_level", "division"), "class_id"))
    return (x.select("payment_id", "amount_paid", "payment_date", "payment_mode", "receipt_no",
                     full_name("fname", "lname").alias("student_name"), "reg_no", "class_level", "division")
            .orderBy(F.desc("payment_date"), F.desc("payment_id")).limit(n))


def _in_year(col: str, year: int) -> "F.Column":
    # Half-open date range instead of YEAR(x) = y so the filter reaches the Parquet scan.
    return (F.col(col) >= F.lit(dt.date(year, 1, 1))) & (F.col(col) < F.lit(dt.date(year + 1, 1, 1)))


def monthly_collection(s: School, year: int | None = None) -> DataFrame:
    """Per month of a year (or of every year): count and sum of payments."""
    p = s.fee_payments if year is None else s.fee_payments.where(_in_year("payment_date", year))
    return (p.groupBy(F.year("payment_date").alias("year"), F.month("payment_date").alias("month"),
                      F.date_format("payment_date", "MMMM").alias("month_name"))
            .agg(F.count(F.lit(1)).alias("transaction_count"), F.sum("amount_paid").alias("total_collected"))
            .orderBy("year", "month"))


def collection_by_day(s: School, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Per day in an inclusive date range (open ends allowed): count and sum."""
    p = s.fee_payments
    if start is not None:
        p = p.where(F.col("payment_date") >= F.lit(start))
    if end is not None:
        p = p.where(F.col("payment_date") <= F.lit(end))
    return (p.groupBy("payment_date")
            .agg(F.count(F.lit(1)).alias("transactions"), F.sum("amount_paid").alias("total_collected"))
            .orderBy("payment_date"))


def payment_modes(s: School, as_of: dt.date) -> DataFrame:
    """Per payment mode in as_of's calendar year: count and sum, largest sum first."""
    return (s.fee_payments.where(_in_year("payment_date", as_of.year))
            .groupBy("payment_mode")
            .agg(F.count(F.lit(1)).alias("transaction_count"), F.sum("amount_paid").alias("total_amount"))
            .orderBy(F.desc("total_amount"), "payment_mode"))


def accountant_dashboard(s: School, as_of: dt.date, totals: FeeTotals | None = None) -> DataFrame:
    """One row — active students, this month's and all-time collection, active pending.

    Both collection figures come from one pass over payments (a conditional sum);
    the other two are scalar subqueries, so no cross join is needed.
    """
    enr = in_active_year(s.student_enrollments, s.academic_years)
    month_start = dt.date(as_of.year, as_of.month, 1)
    next_month = dt.date(as_of.year + (as_of.month == 12), as_of.month % 12 + 1, 1)
    in_month = (F.col("payment_date") >= F.lit(month_start)) & (F.col("payment_date") < F.lit(next_month))
    per_enr = (enr.select("enrollment_id").join(assignments_by_enrollment(s, enr, totals), "enrollment_id", "inner")
               .join(paid_by_enrollment(s, enr, totals), "enrollment_id", "left"))
    pending = F.col("fee") - F.col("n_assign") * zero_if_null("paid")
    students = enr.agg(F.count(F.lit(1))).scalar()
    total_pending = per_enr.agg(zero_if_null(F.sum(pending))).scalar()
    days = s.fee_payments.select("payment_date", "amount_paid") if totals is None else totals.daily.select("payment_date", F.col("collected").alias("amount_paid"))
    collections = days.agg(
        zero_if_null(F.sum(F.when(in_month, F.col("amount_paid")))).alias("monthly_collection"),
        zero_if_null(F.sum("amount_paid")).alias("total_collected"))
    return collections.select(students.alias("total_students"), "monthly_collection", "total_collected",
                              total_pending.alias("total_pending"))

"""Fee totals kept as tables, and table changes folded in as signed rows.

The sums behind the fee reports add up: a row that is stored counts +1 time, a row that
goes counts -1, and a changed row is its old form going and its new form being stored.
A batch then costs one aggregate over the totals and the batch; payments and assignments
themselves are not read again.  The fan-out of R1 and R8 needs no more than the numbers
of copies and payments, which are kept beside the sums.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.plans.dims import by_key, cut_lineage
from rollbook.sources.store import School

MONEY = "decimal(20,2)"
TABLES = ("assigned", "paid", "daily")


@dataclasses.dataclass(frozen=True)
class FeeTotals:
    """``assigned`` (enrollment_id, total_amount, n_copies), ``paid`` (enrollment_id, paid,
    n_payments) and ``daily`` (payment_date, collected, n_payments)."""

    assigned: DataFrame
    paid: DataFrame
    daily: DataFrame


@dataclasses.dataclass(frozen=True)
class FeeChange:
    """Rows of fee payments and assignments that a change has stored and removed (None: none)."""

    payments_in: DataFrame | None = None
    payments_out: DataFrame | None = None
    assignments_in: DataFrame | None = None
    assignments_out: DataFrame | None = None


def _signed(stored: DataFrame | None, gone: DataFrame | None, *cols: str) -> DataFrame | None:
    sides = [x.select(*cols, F.lit(n).cast("long").alias("n")) for x, n in ((stored, 1), (gone, -1)) if x is not None]
    return None if not sides else sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


def _copies(rows: DataFrame) -> DataFrame:
    return rows.groupBy("enrollment_id", "total_amount").agg(F.sum("n").alias("n_copies")).where("n_copies <> 0")


def _sums(rows: DataFrame, key: str, total: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sum("amount").cast(MONEY).alias(total), F.sum("n").alias("n_payments")).where(f"n_payments <> 0 or {total} <> 0")


def _amounts(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, (F.col("amount_paid") * F.col("n")).cast(MONEY).alias("amount"), "n")


def count_totals(s: School) -> FeeTotals:
    """The totals of the school's payments and assignments, counted from all rows."""
    payments = _signed(s.fee_payments, None, "enrollment_id", "payment_date", "amount_paid")
    return FeeTotals(_copies(_signed(s.student_fee_assignments, None, "enrollment_id", "total_amount")),
                     _sums(_amounts(payments, "enrollment_id"), "enrollment_id", "paid"),
                     _sums(_amounts(payments, "payment_date"), "payment_date", "collected"))


def fold(totals: FeeTotals, change: FeeChange) -> FeeTotals:
    """The totals after ``change``: each is one aggregate of its rows and the signed rows.

    A total whose rows are all gone leaves the table.  Removed rows that were never counted leave
    a negative number behind, which ``impossible`` finds.  The result is checkpointed, so
    that folding batch after batch does not lengthen the plan.
    """
    assigned, paid, daily = totals.assigned, totals.paid, totals.daily
    rows = _signed(change.assignments_in, change.assignments_out, "enrollment_id", "total_amount")
    if rows is not None:
        assigned = cut_lineage(_copies(assigned.withColumnRenamed("n_copies", "n").unionByName(rows)))
    rows = _signed(change.payments_in, change.payments_out, "enrollment_id", "payment_date", "amount_paid")
    if rows is not None:
        old = lambda t, key, total: t.select(key, F.col(total).alias("amount"), F.col("n_payments").alias("n"))
        paid = cut_lineage(_sums(old(paid, "enrollment_id", "paid").unionByName(_amounts(rows, "enrollment_id")), "enrollment_id", "paid"))
        daily = cut_lineage(_sums(old(daily, "payment_date", "collected").unionByName(_amounts(rows, "payment_date")), "payment_date", "collected"))
    return FeeTotals(assigned, paid, daily)


def impossible(totals: FeeTotals) -> DataFrame:
    """(total, key, n) of totals that count fewer than no rows, or money without rows."""
    of = lambda t, name, key, n, more="false": t.where(f"{n} < 0 or {more}").select(
        F.lit(name).alias("total"), F.col(key).cast("string").alias("key"), F.col(n).alias("n"))
    return (of(totals.assigned, "assigned", "enrollment_id", "n_copies")
            .unionByName(of(totals.paid, "paid", "enrollment_id", "n_payments", "(n_payments = 0 and paid <> 0)"))
            .unionByName(of(totals.daily, "daily", "payment_date", "n_payments", "(n_payments = 0 and collected <> 0)")))


def write_totals(totals: FeeTotals, path: str) -> None:
    """Write the totals below a fresh ``path``, clustered by their keys."""
    for name, key in zip(TABLES, ("enrollment_id", "enrollment_id", "payment_date")):
        getattr(totals, name).repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{path}/{name}")


def read_totals(spark: SparkSession, path: str) -> FeeTotals:
    return FeeTotals(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])


# -- what the library's changes store and remove ------------------------------------------------

def payments_stored(accepted: DataFrame) -> FeeChange:
    """Accepted payments."""
    return FeeChange(payments_in=accepted)


def fees_assigned(before: School, assignments: DataFrame, keys: DataFrame) -> FeeChange:
    """``assignments`` is the table after the upsert of the enrollments in ``keys``."""
    of = lambda t: t.join(by_key(keys.select("enrollment_id").distinct()), "enrollment_id", "left_semi")
    return FeeChange(assignments_in=of(assignments), assignments_out=of(before.student_fee_assignments))


def enrollments_deleted(before: School, gone: DataFrame) -> FeeChange:
    """The payments and assignments that go with the enrollments in ``gone``."""
    of = lambda t: t.join(by_key(gone.select("enrollment_id").distinct()), "enrollment_id", "left_semi")
    return FeeChange(payments_out=of(before.fee_payments), assignments_out=of(before.student_fee_assignments))

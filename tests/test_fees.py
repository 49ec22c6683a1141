"""Fee reports on hand-made cases: overpayment, exact settlement, duplicate
assignments (payments counted per copy), no payments, date ranges."""

from __future__ import annotations

import datetime as dt

import pytest

from conftest import D, make_school
from rollbook.operators import fees


@pytest.fixture
def school(spark, base_rows):
    rows = dict(base_rows)
    rows["student_fee_assignments"] = [
        {"assignment_id": 1, "enrollment_id": 501, "total_amount": 1000, "assigned_date": "2024-01-01"},
        {"assignment_id": 2, "enrollment_id": 502, "total_amount": 1000, "assigned_date": "2024-01-01"},
        {"assignment_id": 3, "enrollment_id": 502, "total_amount": 1000, "assigned_date": "2024-01-01"},
        {"assignment_id": 4, "enrollment_id": 503, "total_amount": 500, "assigned_date": "2024-01-01"},
        {"assignment_id": 5, "enrollment_id": 504, "total_amount": 800, "assigned_date": "2023-01-01"},
    ]
    rows["fee_payments"] = [
        {"payment_id": 1, "enrollment_id": 501, "amount_paid": 400, "payment_date": "2024-03-05",
         "payment_mode": "Cash", "receipt_no": "R1"},
        {"payment_id": 2, "enrollment_id": 501, "amount_paid": 700, "payment_date": "2024-02-01",
         "payment_mode": "UPI", "receipt_no": "R2"},
        {"payment_id": 3, "enrollment_id": 502, "amount_paid": 300, "payment_date": "2024-03-31",
         "payment_mode": "Cash", "receipt_no": "R3"},
        {"payment_id": 4, "enrollment_id": 504, "amount_paid": 800, "payment_date": "2023-05-01",
         "payment_mode": "Bank", "receipt_no": "R4"},
    ]
    return make_school(spark, **rows)


def test_defaulters_counts_payments_once_per_assignment_copy(school):
    rows = fees.defaulters(school).collect()
    assert [r.enrollment_id for r in rows] == [503, 502]           # largest pending first
    by = {r.enrollment_id: r for r in rows}
    assert by[503].total_paid == D(0) and by[503].pending_amount == D(500)
    # Two equal assignments of 1000 for 502: the 300 paid is summed once per copy.
    assert by[502].total_paid == D(600) and by[502].pending_amount == D(400)
    assert by[502].student_name == "Bo "                           # NULL lname keeps the space


def test_overpaid_and_settled_are_not_defaulters(spark, base_rows):
    rows = dict(base_rows)
    rows["student_fee_assignments"] = [
        {"assignment_id": 1, "enrollment_id": 501, "total_amount": 700, "assigned_date": "2024-01-01"},
        {"assignment_id": 2, "enrollment_id": 503, "total_amount": 700, "assigned_date": "2024-01-01"}]
    rows["fee_payments"] = [
        {"payment_id": 1, "enrollment_id": 501, "amount_paid": 700, "payment_date": "2024-01-02"},
        {"payment_id": 2, "enrollment_id": 503, "amount_paid": 900, "payment_date": "2024-01-02"}]
    s = make_school(spark, **rows)
    assert fees.defaulters(s).count() == 0


def test_fee_status_keeps_unassigned_and_sorts_level_numerically(school, spark, base_rows):
    rows = {r.enrollment_id: r for r in fees.fee_status(school).collect()}
    assert rows[501].total_amount == D(1000) and rows[501].total_pending == D(-100)
    assert rows[502].total_paid == D(600)
    levels = [r.class_level for r in fees.fee_status(school).collect()]
    assert levels == sorted(levels) and levels[-1] == 10           # 10 after 9, not before
    s = make_school(spark, **base_rows)                            # nobody assigned, nobody paid
    r = {x.enrollment_id: x for x in fees.fee_status(s).collect()}
    assert r[501].total_amount == D(0) and r[501].total_paid == D(0) and r[501].total_pending == D(0)


def test_fee_summary_exact_versus_as_written(school):
    exact = {r.academic_year_id: r for r in fees.fee_summary(school).collect()}[7002]
    assert (exact.total_fees, exact.collected, exact.pending) == (D(3500), D(1400), D(2100))
    aw = {r.academic_year_id: r for r in fees.fee_summary_as_written(school).collect()}[7002]
    # 501: fee x 2 payments; 502: 2 fees x 1 payment, paid x 2 copies; 503: no payment.
    assert (aw.total_fees, aw.collected, aw.pending) == (D(4500), D(1700), D(2800))
    assert exact.pending == exact.total_fees - exact.collected


def test_class_wise_sums_match_active_year_totals(school):
    rows = fees.class_wise_fees(school).collect()
    assert sum(r.total_students for r in rows) == 3
    assert sum(r.total_fee for r in rows) == D(3500)
    by = {r.class_id: r for r in rows}
    assert by[3001].total_collected == D(1100 + 300 * 2)           # paid counted per assignment row


def test_fee_balance_default_row(school):
    rows = fees.fee_balance(school, with_default=True).collect()
    missing = [r for r in rows if r.assignment_id is None]
    assert missing == []                                           # every enrollment has one here
    bal = {r.assignment_id: r.balance for r in rows}
    assert bal[2] == D(700) and bal[3] == D(700)


def test_monthly_and_daily_collection(school):
    m = {(r.year, r.month): r for r in fees.monthly_collection(school, 2024).collect()}
    assert m[(2024, 3)].month_name == "March" and m[(2024, 3)].total_collected == D(700)
    assert m[(2024, 3)].transaction_count == 2 and (2023, 5) not in m
    d = fees.collection_by_day(school, dt.date(2024, 3, 5), dt.date(2024, 3, 31)).collect()
    assert [r.payment_date for r in d] == [dt.date(2024, 3, 5), dt.date(2024, 3, 31)]   # inclusive


def test_payment_modes_and_dashboard(school):
    modes = fees.payment_modes(school, dt.date(2024, 6, 1)).collect()
    assert [(r.payment_mode, r.total_amount) for r in modes] == [("Cash", D(700)), ("UPI", D(700))]  # tie: by name
    row = fees.accountant_dashboard(school, dt.date(2024, 3, 10)).collect()[0]
    assert row.total_students == 3
    assert row.monthly_collection == D(700)
    assert row.total_collected == D(2200)
    assert row.total_pending == D(-100 + 700 + 700 + 500)


def test_recent_transactions_tiebreak(school):
    rows = fees.recent_transactions(school, 2).collect()
    assert [r.payment_id for r in rows] == [3, 1]


def test_two_active_years_both_count(spark, base_rows):
    rows = dict(base_rows)
    rows["academic_years"] = [dict(y, is_active=True) for y in base_rows["academic_years"]]
    rows["student_fee_assignments"] = [
        {"assignment_id": 1, "enrollment_id": 504, "total_amount": 800, "assigned_date": "2023-01-01"}]
    s = make_school(spark, **rows)
    assert [r.enrollment_id for r in fees.defaulters(s).collect()] == [504]

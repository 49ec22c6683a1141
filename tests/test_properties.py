"""Properties: Column functions against a plain-Python model; keyed variants equal
the whole-table result restricted to the keys."""

from __future__ import annotations

import decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import D, make_school
from rollbook.functions.exprs import grade, percentage
from rollbook.operators import fees, marks, people

cents = st.integers(min_value=0, max_value=99999).map(lambda c: decimal.Decimal(c) / 100)


def model_grade(o, m):
    if m is None or m <= 0:
        return None
    o = o if o is not None else decimal.Decimal(0)
    for bound, letter in [(90, "A+"), (80, "A"), (70, "B"), (60, "C"), (40, "D")]:
        if o * 100 >= m * bound:
            return letter
    return "F"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), cents), cents), min_size=1, max_size=300))
def test_grade_matches_model(spark, pairs):
    df = spark.createDataFrame([(o, m) for o, m in pairs], "o decimal(5,2), m decimal(5,2)")
    got = [r.g for r in df.select(grade("o", "m").alias("g")).collect()]
    assert got == [model_grade(o, m) for o, m in pairs]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), cents), cents), min_size=1, max_size=300))
def test_percentage_is_exact_half_up(spark, pairs):
    df = spark.createDataFrame([(o, m) for o, m in pairs], "o decimal(15,2), m decimal(15,2)")
    got = [r.p for r in df.select(percentage("o", "m").alias("p")).collect()]
    want = []
    for o, m in pairs:
        if o is None or m == 0:
            want.append(None)
        else:
            q = decimal.Context(prec=50).divide(o * 100, m)
            want.append(q.quantize(decimal.Decimal("0.01"), rounding=decimal.ROUND_HALF_UP))
    assert got == want


def test_keyed_variants_equal_restricted_whole(spark, base_rows):
    rows = dict(base_rows)
    rows["fee_payments"] = [
        {"payment_id": i, "enrollment_id": e, "amount_paid": 10 * i, "payment_date": f"2024-01-0{i}"}
        for i, e in [(1, 501), (2, 502), (3, 501), (4, 503)]]
    rows["student_fee_assignments"] = [
        {"assignment_id": 1, "enrollment_id": 501, "total_amount": 100, "assigned_date": "2024-01-01"}]
    s = make_school(spark, **rows)
    keys = spark.createDataFrame([(501,), (503,)], "enrollment_id long")
    whole = {tuple(r) for r in fees.payment_history(s).collect() if r.enrollment_id in (501, 503)}
    assert {tuple(r) for r in fees.payment_history(s, keys).collect()} == whole
    bal = fees.fee_balance(s, keys, with_default=True).collect()
    assert sorted((r.enrollment_id, r.total_paid) for r in bal) == [(501, D(40)), (503, D(0))]
    ukeys = spark.createDataFrame([(20,)], "user_id long")
    assert [r.enrollment_id for r in marks.student_dashboard(s, ukeys).collect()] == [501]
    assert [r.user_id for r in people.employee_profile(s, spark.createDataFrame([(11,)], "user_id long"))
            .collect()] == [11]


def test_accent_insensitive_search(spark, base_rows):
    rows = dict(base_rows)
    rows["subjects"] = [{"subject_id": 5009, "subject_name": "Música", "class_id": 3001, "teacher_id": 2001,
                         "academic_year_id": 7002}]
    s = make_school(spark, **rows)
    assert people.search(s.subjects, "subject_name", "MUSICA").count() == 0
    assert people.search(s.subjects, "subject_name", "MUSICA", accent_insensitive=True).count() == 1

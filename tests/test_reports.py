"""Marks, people and audit reports on hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import D, make_school
from rollbook.functions.exprs import full_name, full_name_strict, grade, percentage
from rollbook.operators import audit, marks, people


@pytest.mark.parametrize("obtained,mx,want", [
    (39.99, 100, "F"), (40, 100, "D"), (59.99, 100, "D"), (60, 100, "C"), (69.99, 100, "C"),
    (70, 100, "B"), (80, 100, "A"), (89.99, 100, "A"), (90, 100, "A+"), (120, 100, "A+"),
    (None, 100, "F"), (45, 0, None), (18, 20, "A+"), (7.99, 20, "F"),
])
def test_grade_bands(spark, obtained, mx, want):
    df = spark.createDataFrame([(D(obtained) if obtained is not None else None, D(mx))],
                               "o decimal(5,2), m decimal(5,2)")
    assert df.select(grade("o", "m").alias("g")).first().g == want


def test_percentage_half_up_and_zero_max(spark):
    df = spark.createDataFrame([(D(1), D(3)), (D(2), D(3)), (D(1), D(8)), (D(5), D(0)), (None, D(10))],
                               "o decimal(15,2), m decimal(15,2)")
    got = [r.p for r in df.select(percentage("o", "m").alias("p")).collect()]
    assert got == [D("33.33"), D("66.67"), D("12.50"), None, None]


def test_names_null_lname(spark):
    df = spark.createDataFrame([("Ann", None), ("Bo", "Li")], "f string, l string")
    rows = df.select(full_name("f", "l").alias("a"), full_name_strict("f", "l").alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [("Ann ", None), ("Bo Li", "Bo Li")]


@pytest.fixture
def school(spark, base_rows):
    rows = dict(base_rows)
    rows["marks"] = [
        # 501: 90 + 80 of 200 = 85 %; 502: same 85 % (tie), 503: all marks NULL.
        {"mark_id": 1, "enrollment_id": 501, "subject_id": 5001, "exam_id": 8001, "marks_obtained": 90,
         "max_marks": 100, "grade": "A+"},
        {"mark_id": 2, "enrollment_id": 501, "subject_id": 5002, "exam_id": 8001, "marks_obtained": 80,
         "max_marks": 100, "grade": "A"},
        {"mark_id": 3, "enrollment_id": 502, "subject_id": 5001, "exam_id": 8001, "marks_obtained": 85,
         "max_marks": 100, "grade": "A"},
        {"mark_id": 4, "enrollment_id": 502, "subject_id": 5002, "exam_id": 8001, "marks_obtained": 85,
         "max_marks": 100, "grade": "A"},
        {"mark_id": 5, "enrollment_id": 503, "subject_id": 5001, "exam_id": 8001, "marks_obtained": None,
         "max_marks": 100, "grade": "F"},
    ]
    rows["attendance_students"] = [
        {"attendance_id": 1, "enrollment_id": 501, "attendance_date": "2024-02-01", "status": "Present"},
        {"attendance_id": 2, "enrollment_id": 501, "attendance_date": "2024-02-02", "status": "Absent"},
        {"attendance_id": 3, "enrollment_id": 501, "attendance_date": "2024-03-01", "status": "Present"},
    ]
    return make_school(spark, **rows)


def test_class_performance_keeps_all_null_marks(school):
    rows = {r.enrollment_id: r for r in marks.class_performance(school).collect()}
    assert rows[501].percentage == D(85) and rows[501].total_subjects == 2
    assert rows[503].percentage is None and rows[503].total_marks_obtained is None
    assert 504 not in rows                                         # not in the active year


def test_top_students_ties_and_null_totals(school):
    rows = marks.top_students(school, 3001, 1).collect()
    assert [(r.enrollment_id, r.rank) for r in rows] == [(501, 1)]   # tie at 85 %: lower id wins
    all_rows = marks.top_students(school, None, 10).collect()
    assert 503 not in {r.enrollment_id for r in all_rows}          # NULL total is dropped


def test_attendance_month_and_dashboard(school):
    m = {(r.year, r.month): r for r in marks.attendance_month(school, keys=None).collect()}
    feb = m[(2024, 2)]
    assert (feb.total_days, feb.present_days, feb.absent_days) == (2, 1, 1)
    assert [x.status for x in feb.records] == ["Present", "Absent"]
    d = {r.enrollment_id: r for r in marks.student_dashboard(school).collect()}
    assert d[501].total_days == 3 and d[501].present_days == 2
    assert d[501].subjects == ["Art", "Maths"] and d[501].class_teacher == "Tara "
    assert 503 not in d                                            # no login → not reachable


def test_teacher_dashboard_zero_for_accountant(school):
    rows = {r.employee_id: r for r in marks.teacher_dashboard(school).collect()}
    assert (rows[2001].total_classes, rows[2001].total_subjects, rows[2001].total_students) == (1, 2, 2)
    assert (rows[2002].total_classes, rows[2002].total_subjects, rows[2002].total_students) == (0, 0, 0)


def test_search_is_case_insensitive_and_literal(spark, base_rows):
    rows = dict(base_rows)
    rows["subjects"] = base_rows["subjects"] + [
        {"subject_id": 5003, "subject_name": "100% Maths", "class_id": 3002, "teacher_id": 2001,
         "academic_year_id": 7002}]
    s = make_school(spark, **rows)
    assert {r.subject_id for r in people.search_subjects(s, "MATH").collect()} == {5001, 5003}
    assert {r.subject_id for r in people.search_subjects(s, "0%").collect()} == {5003}
    assert people.search_subjects(s, "M_ths").count() == 0         # '_' is not a wildcard


def test_students_by_year_drops_class_of_other_year(spark, base_rows):
    rows = dict(base_rows)
    rows["student_enrollments"] = base_rows["student_enrollments"] + [
        {"enrollment_id": 505, "student_master_id": 304, "academic_year_id": 7002, "class_id": 3003,
         "roll_no": 7, "admission_date": "2024-01-01", "status": "active"}]
    s = make_school(spark, **rows)
    live = {r.enrollment_id for r in people.students_by_year(s, 7002).collect()}
    shadowed = {r.enrollment_id for r in people.students_by_year(s, 7002, match_year=False).collect()}
    assert 505 not in live and 505 in shadowed
    assert [r.enrollment_id for r in audit.audit_enrollment_class_year(s).collect()] == [505]


def test_counts_keep_zero(school):
    per_class = {r.class_id: r.total_subjects for r in people.subject_count_per_class(school).collect()}
    assert per_class == {3001: 2, 3002: 0, 3003: 0}
    dash = {r.academic_year_id: r for r in people.admin_dashboard(school).collect()}
    assert (dash[7002].total_classes, dash[7002].total_students, dash[7002].total_teachers) == (2, 3, 1)


def test_audits(spark, base_rows):
    rows = dict(base_rows)
    rows["users"] = base_rows["users"] + [{"user_id": 99, "username": "E1", "role": "boss", "status": None}]
    rows["employees"] = base_rows["employees"] + [
        {"employee_id": 2003, "user_id": 777, "fname": "X", "reg_no": "E3", "mobile": None},
        {"employee_id": 2004, "user_id": 10, "fname": "Y", "reg_no": "E4", "mobile": None}]
    s = make_school(spark, **rows)
    dup = audit.audit_all_unique(s).collect()
    assert [(r.table_name, r.columns, r.key, r.n) for r in dup] == [("users", "username", "E1", 2)]
    fk = audit.audit_all_foreign_keys(s).collect()
    assert [(r.child_table, r.child_column, r.value) for r in fk] == [("employees", "user_id", 777)]
    vals = {(r.table_name, r.rule): r.violations for r in audit.audit_all_values(s).collect()}
    assert vals[("users", "allowed:role")] == 1 and vals[("users", "allowed:status")] == 0
    assert vals[("student_master", "not_null:fname")] == 0

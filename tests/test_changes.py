"""Table changes: ids, rejections, idempotency, promotion rules, cascades."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import D, make_school
from rollbook.operators import audit, changes, lifecycle


@pytest.fixture
def school(spark, base_rows):
    return make_school(spark, **base_rows)


def _content(df, drop):
    return sorted(tuple(r) for r in df.drop(*drop).collect())


def test_assign_ids_dense_and_ordered_across_partitions(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5003).alias("k")).distinct()
    out = changes.assign_ids(df.repartition(5), "new_id", F.lit(100).cast("long"), ["k"])
    rows = sorted((r.k, r.new_id) for r in out.collect())
    assert [i for _k, i in rows] == list(range(101, 101 + len(rows)))   # dense, in key order


def test_append_payments_defaults_ids_and_rejections(school, spark):
    batch = spark.createDataFrame(
        [(501, D(10), dt.date(2024, 5, 1), None, None),        # ok, mode defaults to Cash
         (502, D(20), dt.date(2024, 5, 2), "Card", None),      # bad enum
         (999, D(30), dt.date(2024, 5, 3), "UPI", None),       # no such enrollment
         (503, None, dt.date(2024, 5, 4), "UPI", None),        # missing amount
         (503, D(40), dt.date(2024, 5, 5), "UPI", "R9"),       # ok with given receipt
         (501, D(50), dt.date(2024, 5, 6), "UPI", "R9")],      # same receipt later in batch
        "enrollment_id long, amount_paid decimal(10,2), payment_date date, payment_mode string, receipt_no string")
    acc, rej = changes.append_rows(school, "fee_payments", batch, ["payment_date"],
                                   fill={"receipt_no": changes.payment_receipt()})
    got = sorted((r.payment_id, r.enrollment_id, r.payment_mode, r.receipt_no) for r in acc.collect())
    assert got == [(3501, 501, "Cash", "RCP3501"), (3502, 503, "UPI", "R9")]
    reasons = sorted((r.enrollment_id, r.reason) for r in rej.collect())
    assert reasons == [(501, "duplicate_in_batch:receipt_no"), (502, "bad_value:payment_mode"),
                       (503, "missing:amount_paid"), (999, "missing_parent:enrollment_id")]
    assert acc.count() + rej.count() == batch.count()


def test_update_rows_with_where(school, spark):
    ch = spark.createDataFrame([(10, "inactive"), (11, "active")], "user_id long, status string")
    out = {r.user_id: r.status for r in changes.update_rows(school.users, ch, "user_id",
                                                            F.col("role") == "teacher").collect()}
    assert out[10] == "inactive" and out[11] == "inactive"          # accountant row not touched
    n = changes.changed_count(school.users, ch, "user_id", F.col("role") == "teacher").first().changed
    assert n == 1


def test_toggle_status(school, spark):
    keys = spark.createDataFrame([(501,), (501,)], "enrollment_id long")
    once = changes.toggle_status(school.student_enrollments, keys)
    twice = changes.toggle_status(once, keys)
    st = lambda df: {r.enrollment_id: r.status for r in df.collect()}
    assert st(once)[501] == "left" and st(twice)[501] == "active"


def test_assign_fees_upsert_idempotent_and_dedupe(school, spark):
    batch = spark.createDataFrame([(501, D(900), dt.date(2024, 2, 1)), (503, D(700), dt.date(2024, 2, 1))],
                                  "enrollment_id long, total_amount decimal(10,2), assigned_date date")
    once, _ = changes.assign_fees(school, batch, "upsert")
    twice, _ = changes.assign_fees(school.replace(student_fee_assignments=once), batch, "upsert")
    assert _content(once, []) == _content(twice, [])
    appended, _ = changes.assign_fees(school.replace(student_fee_assignments=once), batch, "append")
    assert appended.count() == 4
    assert changes.dedupe_assignments(appended).count() == 2


def test_upsert_fee_structure(school, spark):
    batch = spark.createDataFrame([(9, 7002, D(1200)), (10, 7002, D(1500))],
                                  "class_level int, academic_year_id long, total_amount decimal(10,2)")
    out = {(r.class_level, r.academic_year_id): (r.structure_id, r.total_amount)
           for r in changes.upsert_fee_structure(school, batch)[0].collect()}
    assert out == {(9, 7002): (1501, D(1200)), (10, 7002): (1502, D(1500))}


def test_mark_attendance_replaces_and_rejects_batch_duplicates(school, spark):
    s = school.replace(attendance_students=spark.createDataFrame(
        [(6001, 501, dt.date(2024, 2, 1), "Present")], school.attendance_students.schema))
    batch = spark.createDataFrame([(501, dt.date(2024, 2, 1), "Absent"), (502, dt.date(2024, 2, 1), "Present"),
                                   (502, dt.date(2024, 2, 1), "Absent")],
                                  "enrollment_id long, attendance_date date, status string")
    table, rej = changes.mark_attendance(s, batch)
    got = sorted((r.attendance_id, r.enrollment_id, r.status) for r in table.collect())
    assert got == [(6002, 501, "Absent"), (6003, 502, "Present")]
    assert [r.reason for r in rej.collect()] == ["duplicate_in_batch:enrollment_id,attendance_date"]
    again, _ = changes.mark_attendance(s.replace(attendance_students=table), batch)
    assert _content(again, ["attendance_id"]) == _content(table, ["attendance_id"])


def test_add_marks_creates_exam_grades_and_replaces(school, spark):
    batch = spark.createDataFrame(
        [(5001, "Retest", 50, 501, 45), (5001, "Retest", 50, 502, None), (5002, "Final", 0, 501, 10),
         (5002, "Final", 100, 501, 65)],
        "subject_id long, exam_name string, max_marks int, enrollment_id long, marks_obtained int")
    s2, acc, rej = lifecycle.add_marks(school, batch)
    assert {(r.exam_id, r.exam_name) for r in s2.exams.collect()} == {(8001, "Final"), (8002, "Retest")}
    got = sorted((r.enrollment_id, r.subject_id, r.exam_id, r.grade) for r in acc.collect())
    assert got == [(501, 5001, 8002, "A+"), (501, 5002, 8001, "C"), (502, 5001, 8002, "F")]
    assert [r.reason for r in rej.collect()] == ["invalid_data"]    # max_marks 0 is refused
    s3, _, _ = lifecycle.add_marks(s2, batch)
    assert _content(s3.marks, ["mark_id"]) == _content(s2.marks, ["mark_id"])   # idempotent content


def test_promote_rules(spark, base_rows):
    rows = dict(base_rows)
    rows["academic_years"] = base_rows["academic_years"] + [
        {"academic_year_id": 7003, "year_name": "2025-26", "start_date": "2025-01-01", "end_date": "2025-12-31",
         "is_active": False, "is_closed": False}]
    rows["classes"] = base_rows["classes"] + [
        {"class_id": 3010, "class_level": 10, "division": "A", "academic_year_id": 7003}]
    s = make_school(spark, **rows)
    mapping = spark.createDataFrame(
        [(7002, 3001, 7003, 3010),      # ok: two active students move
         (7002, 3002, 7003, None),      # level 10 passes
         (7001, 3003, 7003, 3999),      # target missing
         (7002, 3009, 7003, 3010)],     # no students
        "from_year long, from_class long, to_year long, to_class long")
    enr, refused = lifecycle.promote(s, mapping)
    assert sorted((r.from_class, r.reason) for r in refused.collect()) == [
        (3003, "target_missing"), (3009, "no_students")]
    rows_ = {r.enrollment_id: r for r in enr.collect()}
    assert rows_[501].status == "promoted" and rows_[503].status == "passed" and rows_[504].status == "active"
    new = sorted((r.enrollment_id, r.student_master_id, r.class_id, r.roll_no, r.admission_date)
                 for r in enr.where(F.col("academic_year_id") == 7003).collect())
    assert new == [(505, 301, 3010, 1, dt.date(2025, 1, 1)), (506, 302, 3010, 2, dt.date(2025, 1, 1))]
    again, refused2 = lifecycle.promote(s.replace(student_enrollments=enr), mapping.limit(1))
    assert [r.reason for r in refused2.collect()] == ["no_students"]   # everyone is 'promoted' now
    assert audit.audit_unique(enr, ["class_id", "roll_no"]).count() == 0


def test_admit_students_all_or_nothing(school, spark):
    batch = spark.createDataFrame(
        [("N1", "Eve", "Female", 5, 3001, 7002, dt.date(2024, 6, 1)),
         ("S1", "Dup", "Male", 6, 3001, 7002, dt.date(2024, 6, 1)),      # reg_no taken
         ("N2", "Fay", "Female", 1, 3001, 7002, dt.date(2024, 6, 1)),    # roll 1 taken in class
         ("N3", "Gus", None, 7, 3001, 7002, dt.date(2024, 6, 1))],       # gender missing
        "reg_no string, fname string, gender string, roll_no int, class_id long, academic_year_id long, "
        "admission_date date")
    s2, acc, rej = lifecycle.admit_students(school, batch, ["reg_no"])
    assert [(r.reg_no, r.student_master_id, r.enrollment_id) for r in acc.collect()] == [("N1", 305, 505)]
    assert sorted((r.reg_no, r.reason) for r in rej.collect()) == [
        ("N2", "duplicate_key:class_id,roll_no"), ("N3", "missing:gender"), ("S1", "duplicate_key:reg_no")]
    assert s2.student_master.count() == 5 and s2.student_enrollments.count() == 5


def test_register_people_role_split(school, spark):
    batch = spark.createDataFrame(
        [("Hal", "teacher", dt.date(2024, 1, 1), D(100), None, "T9", None),
         ("Ivy", "student", dt.date(2024, 1, 1), None, 9, "S9", 3001),
         ("Jon", "janitor", dt.date(2024, 1, 1), None, None, "J9", None),
         ("Kim", "teacher", dt.date(2024, 1, 1), None, None, "E1", None)],   # username taken
        "fname string, role string, date date, salary decimal(10,2), roll_no int, reg_no string, class_id long")
    s2, acc, rej = lifecycle.register_people(school, batch, ["reg_no"])
    got = sorted((r.username, r.user_id, r.employee_id, r.student_master_id) for r in acc.collect())
    assert got == [("S9", 22, None, 305), ("T9", 23, 2003, None)]
    assert sorted((r.reg_no, r.reason) for r in rej.collect()) == [
        ("E1", "duplicate_key:username"), ("J9", "bad_value:role")]
    enr = s2.student_enrollments.where(F.col("user_id") == 22).first()
    assert (enr.class_id, enr.academic_year_id, enr.roll_no) == (3001, 7002, 9)


def test_delete_cascade(school, spark):
    s = school.replace(marks=spark.createDataFrame(
        [(9001, 501, 5001, 8001, D(50), D(100), "D")], school.marks.schema))
    keys = spark.createDataFrame([(10,), (20,)], "user_id long")
    out = lifecycle.delete_cascade(s, "users", keys)
    assert out.users.count() == 3 and out.employees.count() == 1      # 2001 cascades away
    assert out.subjects.count() == 0 and out.marks.count() == 0       # subjects → marks cascade
    assert {r.class_id: r.class_teacher_id for r in out.classes.collect()}[3001] is None   # set null
    assert {r.enrollment_id: r.user_id for r in out.student_enrollments.collect()}[501] is None
    assert out.student_enrollments.count() == 4


def test_conflicting_changes_resolve_deterministically(school, spark):
    batch = spark.createDataFrame([(501, D(900), dt.date(2024, 2, 1)), (501, D(800), dt.date(2024, 3, 1)),
                                   (501, D(950), dt.date(2024, 3, 1))],
                                  "enrollment_id long, total_amount decimal(10,2), assigned_date date")
    out = changes.assign_fees(school, batch, "upsert")[0].collect()
    assert [(r.enrollment_id, r.total_amount, r.assigned_date) for r in out] == [
        (501, D(950), dt.date(2024, 3, 1))]                   # latest date, then larger amount


def test_generated_ids_skip_ids_the_batch_brings(school, spark):
    batch = spark.createDataFrame([(None, "Tom", "E7"), (2002 + 1, "Una", "E8"), (None, "Val", "E9")],
                                  "employee_id long, fname string, reg_no string") \
        .withColumn("user_id", F.lit(10).cast("long"))
    acc, rej = changes.append_rows(school, "employees", batch, ["reg_no"])
    assert sorted((r.reg_no, r.employee_id) for r in acc.collect()) == [("E7", 2004), ("E8", 2003), ("E9", 2005)]
    assert rej.count() == 0


def test_clash_only_check_without_batch_check(school, spark):
    batch = spark.createDataFrame([("S1", "Dup"), ("N5", "New"), ("N5", "Twin")], "reg_no string, fname string")
    ok = changes.validate_batch(school, "student_master", batch.withColumn("_row", F.monotonically_increasing_id()),
                                ["reg_no"], check_batch=False)
    reasons = sorted((r.reg_no, r.reason) for r in ok.collect())
    assert reasons == [("N5", None), ("N5", None), ("S1", "duplicate_key:reg_no")]


def test_attendance_refused_row_keeps_what_is_stored(school, spark):
    s = school.replace(attendance_students=spark.createDataFrame(
        [(6001, 501, dt.date(2024, 2, 1), "Present")], school.attendance_students.schema))
    batch = spark.createDataFrame([(501, dt.date(2024, 2, 1), "Late")], "enrollment_id long, attendance_date date, status string")
    table, rej = changes.mark_attendance(s, batch)
    assert [tuple(r) for r in table.collect()] == [(6001, 501, dt.date(2024, 2, 1), "Present")]
    assert [r.reason for r in rej.collect()] == ["bad_value:status"]


def test_marks_rows_in_are_rows_out(school, spark):
    batch = spark.createDataFrame(
        [(5001, "x" * 60, "50", 501, "45"), (5001, "Final", "100", 501, "1000"), (5001, "Final", "100", 999, "5"),
         (5001, "Final", "100", 502, "50"), (5001, "Final", "100", 502, "60"), (None, "Final", "100", 502, "60"), (5001, "Final", "1e9", 502, "1")],
        "subject_id long, exam_name string, max_marks string, enrollment_id long, marks_obtained string")
    s2, acc, rej = lifecycle.add_marks(school, batch)
    assert [(r.enrollment_id, r.marks_obtained) for r in acc.collect()] == [(502, D(50))]
    assert sorted((r.reason, r.exam_name[:5], r.marks_obtained) for r in rej.collect()) == [
        ("bad_value:marks_obtained", "Final", "1000"), ("bad_value:max_marks", "Final", "1"),
        ("duplicate_in_batch:enrollment_id,subject_id,exam_id", "Final", "60"), ("invalid_data", "Final", "60"),
        ("missing_parent:enrollment_id", "Final", "5"), ("too_long:exam_name", "xxxxx", "45")]
    assert acc.count() + rej.count() == batch.count() and s2.exams.count() == school.exams.count()
    last = lifecycle.add_marks(school, batch.withColumn("nth", -F.col("marks_obtained").try_cast("int")), ["nth"])[1]
    assert [r.marks_obtained for r in last.collect()] == [D(60)]


def test_fees_are_checked_before_anything_changes(school, spark):
    first = spark.createDataFrame([(501, D(100), dt.date(2024, 1, 1))], "enrollment_id long, total_amount decimal(10,2), assigned_date date")
    s = school.replace(student_fee_assignments=changes.assign_fees(school, first, "upsert")[0])
    bad = spark.createDataFrame([(501, None, dt.date(2024, 2, 1)), (999, D(5), dt.date(2024, 2, 1))], first.schema)
    for mode in ("upsert", "append"):
        table, rej = changes.assign_fees(s, bad, mode)
        assert [(r.enrollment_id, r.total_amount) for r in table.collect()] == [(501, D(100))]
        assert sorted((r.enrollment_id, r.reason) for r in rej.collect()) == [(501, "missing:total_amount"), (999, "missing_parent:enrollment_id")]


def test_promote_repeated_sources_and_students(spark, base_rows):
    rows = dict(base_rows)
    rows["academic_years"] = base_rows["academic_years"] + [
        {"academic_year_id": 7003, "year_name": "2025-26", "start_date": "2025-01-01", "end_date": "2025-12-31", "is_active": False, "is_closed": False}]
    rows["classes"] = base_rows["classes"] + [{"class_id": c, "class_level": 10, "division": d, "academic_year_id": 7003} for c, d in ((3010, "A"), (3011, "B"))]
    s = make_school(spark, **rows)
    cols = "from_year long, from_class long, to_year long, to_class long"
    for extra in ((7002, 3001, 7003, 3011), (7002, 3001, 7003, 3010)):
        enr, refused = lifecycle.promote(s, spark.createDataFrame([(7002, 3001, 7003, 3010), extra, (7002, 3002, None, None)], cols))
        assert sorted((r.from_class, r.reason) for r in refused.collect()) == [(3001, "duplicate_source"), (3002, "missing_parameters")]
        ids = [r.enrollment_id for r in enr.collect()]
        assert len(ids) == len(set(ids)) == 6
        assert audit.audit_unique(enr, ["student_master_id", "academic_year_id"]).count() == 0


def test_checked_updates(school, spark):
    ch = spark.createDataFrame(
        [(501, 2, "active"), (502, 9, "active"), (502, 8, "left"), (503, 1, "gone"), (999, 5, "active"), (None, 1, "active")],
        "enrollment_id long, roll_no int, status string")
    table, rej = changes.update_table(school, "student_enrollments", ch)
    assert sorted((r.enrollment_id or 0, r.roll_no, r.reason) for r in rej.collect()) == [
        (0, 1, "no_row"), (501, 2, "duplicate_key:class_id,roll_no"), (502, 9, "duplicate_in_batch:enrollment_id"),
        (503, 1, "bad_value:status"), (999, 5, "no_row")]
    got = {r.enrollment_id: (r.roll_no, r.status) for r in table.collect()}
    assert got[502] == (8, "left") and got[501][0] == 1 and table.count() == school.student_enrollments.count()
    roles = spark.createDataFrame([(10, "wizard"), (11, "teacher"), (11, "admin")], "user_id long, role string")
    users, rej = changes.update_table(school, "users", roles)
    assert users.count() == school.users.count() and sorted(r.reason for r in rej.collect()) == ["bad_value:role", "duplicate_in_batch:user_id"]
    teacher = spark.createDataFrame([(5001, 987654)], "subject_id long, teacher_id long")
    assert [r.reason for r in changes.update_table(school, "subjects", teacher)[1].collect()] == ["missing_parent:teacher_id"]


def test_closed_years_are_enforced_on_demand(spark, base_rows):
    rows = dict(base_rows)
    rows["academic_years"] = [dict(r, is_closed=True) for r in base_rows["academic_years"]]
    s = make_school(spark, **rows)
    day = spark.createDataFrame([(501, dt.date(2024, 2, 1), "Present")], "enrollment_id long, attendance_date date, status string")
    assert changes.mark_attendance(s, day)[1].count() == 0
    assert [r.reason for r in changes.mark_attendance(s, day, enforce_closed=True)[1].collect()] == ["closed_year"]
    batch = spark.createDataFrame([(5001, "Final", 100, 501, 45)], "subject_id long, exam_name string, max_marks int, enrollment_id long, marks_obtained int")
    assert [r.reason for r in lifecycle.add_marks(s, batch, enforce_closed=True)[2].collect()] == ["closed_year"]
    assert lifecycle.add_marks(s, batch)[2].count() == 0


def test_admission_refuses_empty_values(school, spark):
    batch = spark.createDataFrame([("", "A", "Male", 5, 3001, 7002, dt.date(2024, 6, 1)), ("N1", "", "Male", 5, 3001, 7002, dt.date(2024, 6, 1)),
                                   ("N2", "B", "Male", 0, 3001, 7002, dt.date(2024, 6, 1))],
                                  "reg_no string, fname string, gender string, roll_no int, class_id long, academic_year_id long, admission_date date")
    _, acc, rej = lifecycle.admit_students(school, batch, ["reg_no"])
    assert acc.count() == 0 and sorted(r.reason for r in rej.collect()) == ["missing:fname", "missing:reg_no", "missing:roll_no"]


def test_recent_transactions_skip_orphans(school, spark):
    from rollbook.operators import fees
    s = school.replace(fee_payments=spark.createDataFrame(
        [(1, 501, D(5), dt.date(2024, 1, 1), "Cash", "R1"), (2, 99999, D(5), dt.date(2024, 2, 1), "Cash", "R2")], school.fee_payments.schema))
    assert [r.payment_id for r in fees.recent_transactions(s, 1).collect()] == [1]

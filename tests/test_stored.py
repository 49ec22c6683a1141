"""Stored tables changed by partitions, checked writes, distinct counts from parts, totals by signed rows."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from conftest import D, SF_SMALL, day, make_school
from rollbook.operators import audit, changes, fees, parts, stored, totals
from rollbook.sources.fixtures import derive_school
from rollbook.sources.schema import SCHEMAS


def fresh() -> str:
    return tempfile.mkdtemp(prefix="run-stored-", dir="/tmp") + "/table"


def files(path: str) -> dict[str, set[str]]:
    return {d: {f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")} for d in os.listdir(path) if d.startswith("part=")}


def attendance(spark, base_rows):
    rows = [{"attendance_id": 6001 + i, "enrollment_id": e, "attendance_date": f"2024-{m:02d}-10", "status": "Present"}
            for i, (m, e) in enumerate((m, e) for m in (1, 2, 3) for e in (501, 502))]
    return make_school(spark, **base_rows, attendance_students=rows)


def test_only_the_months_of_a_batch_are_rewritten(spark, base_rows):
    s, path = attendance(spark, base_rows), fresh()
    stored.write_partitioned(s.attendance_students, "attendance_students", path)
    before = files(path)
    batch = spark.createDataFrame([(501, day("2024-02-10"), "Absent"), (502, day("2024-04-01"), "Present"), (999, day("2024-01-10"), "Absent")],
                                  "enrollment_id long, attendance_date date, status string")
    touched, refused = stored.mark_attendance(s, path, batch)
    after = files(path)
    assert touched == [202402, 202404]                                  # a refused row touches nothing
    assert [tuple(r) for r in refused.select("enrollment_id", "reason").collect()] == [(999, "missing_parent:enrollment_id")]
    assert after["part=202401"] == before["part=202401"] and after["part=202403"] == before["part=202403"]
    assert after["part=202402"] != before["part=202402"] and set(after) == {*before, "part=202404"}
    whole = changes.mark_attendance(s, batch)[0]
    now = stored.read_partitioned(spark, "attendance_students", path).drop(stored.PART)
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, whole.collect())) and now.count() == 7


def test_a_batch_without_accepted_rows_changes_no_file(spark, base_rows):
    s, path = attendance(spark, base_rows), fresh()
    stored.write_partitioned(s.attendance_students, "attendance_students", path)
    before = files(path)
    batch = spark.createDataFrame([(999, day("2024-01-10"), "Absent")], "enrollment_id long, attendance_date date, status string")
    assert stored.mark_attendance(s, path, batch)[0] == [] and files(path) == before


def test_a_repeated_batch_leaves_the_same_rows(spark, base_rows):
    s, path = attendance(spark, base_rows), fresh()
    stored.write_partitioned(s.attendance_students, "attendance_students", path)
    batch = spark.createDataFrame([(501, day("2024-02-10"), "Absent")], "enrollment_id long, attendance_date date, status string")
    for _ in range(2):
        stored.mark_attendance(s, path, batch)
    now = stored.read_partitioned(spark, "attendance_students", path)
    assert now.count() == 6 and now.where("enrollment_id = 501 and attendance_date = date '2024-02-10'").first()["status"] == "Absent"


def test_marks_of_other_exams_keep_their_files(spark, base_rows):
    mark = {"subject_id": 5001, "marks_obtained": 50, "max_marks": 100, "grade": "D"}
    base_rows["exams"].append({"exam_id": 8002, "exam_name": "Mid", "academic_year_id": 7002})
    s = make_school(spark, **base_rows, marks=[{"mark_id": 9001, "enrollment_id": 501, "exam_id": 8001, **mark},
                                               {"mark_id": 9002, "enrollment_id": 501, "exam_id": 8002, **mark}])
    path = fresh()
    stored.write_partitioned(s.marks, "marks", path)
    before = files(path)
    batch = spark.createDataFrame([(5001, "Mid", 100, 501, 95)], "subject_id long, exam_name string, max_marks int, enrollment_id long, marks_obtained int")
    now, touched, refused = stored.add_marks(s, path, batch)
    assert touched == [8002] and refused.isEmpty()
    assert files(path)["part=8001"] == before["part=8001"] and files(path)["part=8002"] != before["part=8002"]
    assert sorted((r["mark_id"], r["exam_id"], r["grade"]) for r in now.marks.collect()) == [(9001, 8001, "D"), (9003, 8002, "A+")]


def test_reports_on_stored_attendance_read_the_wanted_months(spark, base_rows):
    s, path = attendance(spark, base_rows), fresh()
    stored.write_partitioned(s.attendance_students, "attendance_students", path)
    of_month = stored.read_partitioned(spark, "attendance_students", path).where(F.col(stored.PART) == 202402)
    plan = of_month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and of_month.count() == 2
    # R21 of that month from one folder equals R21 of the month from the table.
    from rollbook.operators import marks
    rows = lambda df: sorted((r["enrollment_id"], r["total_days"], r["present_days"]) for r in df.collect())
    assert rows(marks.attendance_month(s.replace(attendance_students=of_month.drop(stored.PART)))) == rows(marks.attendance_month(s, 2024, 2))


def test_observed_writes_count_as_the_audit_does(spark):
    s = derive_school(spark, SF_SMALL)
    s = s.replace(subjects=s.subjects.withColumn("teacher_id", F.when(F.col("subject_id") % 2 == 0, F.col("teacher_id"))),
                  users=s.users.withColumn("role", F.when(F.col("user_id") % 3 == 0, F.lit("guest")).otherwise(F.col("role"))))
    for table in ("subjects", "users", "fee_payments"):
        path = fresh()
        seen = sorted(map(tuple, stored.write_observed(s.table(table), table, path).collect()))
        assert seen == sorted(map(tuple, audit.audit_values(s.table(table), table).collect()))
        assert spark.read.parquet(path).count() == s.table(table).count()
        assert table == "fee_payments" or sum(n for *_, n in seen) > 0


def test_an_empty_table_is_written_and_breaks_no_rule(spark):
    path = fresh()
    rows = stored.write_observed(spark.createDataFrame([], SCHEMAS["users"]), "users", path).collect()
    assert rows and all(r["violations"] == 0 for r in rows) and spark.read.schema(SCHEMAS["users"]).parquet(path).count() == 0


def test_parts_merge_into_exact_distinct_counts(spark):
    # Ids of several bitmaps, copies, nulls, ids at a bitmap's edges, and a null group.
    ids = [0, 1, 32767, 32768, 32769, 65536, 10**12, -1, None]
    rows = [("a", m, i) for m in (1, 2) for i in ids] + [("a", 3, 5), ("b", 1, 1), ("b", 1, 1), (None, 1, 7)]
    df = spark.createDataFrame(rows, "k string, month int, id long")
    made = parts.id_parts(df, ["k", "month"], "id")
    found = {r["k"]: r["n"] for r in parts.count_parts(made, ["k"]).collect()}
    assert found == {r["k"]: r["n"] for r in df.groupBy("k").agg(F.countDistinct("id").alias("n")).collect()} == {"a": 9, "b": 1, None: 1}
    later = parts.id_parts(spark.createDataFrame([("b", 4, 2), ("b", 4, 1)], "k string, month int, id long"), ["k", "month"], "id")
    assert {r["k"]: r["n"] for r in parts.count_parts(made.unionByName(later), ["k"]).collect()}["b"] == 2


def test_a_student_in_two_classes_of_a_teacher_counts_once(spark, base_rows):
    base_rows["subjects"].append({"subject_id": 5003, "subject_name": "Art", "class_id": 3003, "teacher_id": 2001, "academic_year_id": 7001})
    base_rows["student_enrollments"].append({"enrollment_id": 505, "student_master_id": 301, "academic_year_id": 7001, "class_id": 3003,
                                             "roll_no": 2, "admission_date": "2023-01-01", "status": "active"})
    s = make_school(spark, **base_rows)
    assert [tuple(r) for r in parts.teacher_students(s, parts.student_parts(s)).collect()] == [(2001, 3)]


def money_school(spark, base_rows):
    return make_school(spark, **base_rows,
                       student_fee_assignments=[{"assignment_id": 2501 + i, "enrollment_id": e, "total_amount": a, "assigned_date": "2024-01-01"}
                                                for i, (e, a) in enumerate([(501, 1000), (501, 1000), (501, 700), (502, 500), (504, 300)])],
                       fee_payments=[{"payment_id": 3501 + i, "enrollment_id": e, "amount_paid": a, "payment_date": d, "payment_mode": "Cash"}
                                     for i, (e, a, d) in enumerate([(501, 100, "2024-01-05"), (501, 50, "2024-02-05"), (502, 500, "2024-01-05"), (503, 10, "2024-01-06")])])


def reports(s, kept=None):
    out = [fees.fee_status(s, kept), fees.fee_summary(s, totals=kept), fees.fee_summary_as_written(s, totals=kept),
           fees.accountant_dashboard(s, dt.date(2024, 1, 31), kept)]
    return [sorted(map(tuple, df.collect()), key=str) for df in out]


def test_totals_after_three_batches_equal_a_recount(spark, base_rows):
    s = money_school(spark, base_rows)
    kept = totals.count_totals(s)
    assert reports(s, kept) == reports(s)
    # Payments, one of a student without assignment.
    new = spark.createDataFrame([(3601, 501, D(25), day("2024-01-09"), "UPI", None), (3602, 503, D(5), day("2024-03-01"), "UPI", None)], SCHEMAS["fee_payments"])
    kept = totals.fold(kept, totals.payments_stored(new))
    s = s.replace(fee_payments=s.fee_payments.unionByName(new))
    assert reports(s, kept) == reports(s)
    # The copies of 501 become one amount, 503 gets its first assignment.
    batch = spark.createDataFrame([(501, D(900), day("2024-02-01")), (503, D(400), day("2024-02-01"))], "enrollment_id long, total_amount decimal(10,2), assigned_date date")
    table, _ = changes.assign_fees(s, batch)
    kept = totals.fold(kept, totals.fees_assigned(s, table, batch))
    s = s.replace(student_fee_assignments=table)
    assert reports(s, kept) == reports(s) and kept.assigned.where("enrollment_id = 501").collect()[0]["n_copies"] == 3
    # An enrollment goes with its money.
    gone = s.student_enrollments.where("enrollment_id = 502")
    kept = totals.fold(kept, totals.enrollments_deleted(s, gone))
    out = lambda t: t.where("enrollment_id <> 502")
    s = s.replace(student_enrollments=out(s.student_enrollments), fee_payments=out(s.fee_payments), student_fee_assignments=out(s.student_fee_assignments))
    assert reports(s, kept) == reports(s)
    again = totals.count_totals(s)
    for name in totals.TABLES:
        assert sorted(map(tuple, getattr(kept, name).collect())) == sorted(map(tuple, getattr(again, name).collect())), name
    assert totals.impossible(kept).isEmpty()


def test_totals_read_back_and_impossible_ones_are_found(spark, base_rows):
    s, path = money_school(spark, base_rows), fresh()
    totals.write_totals(totals.count_totals(s), path)
    kept = totals.read_totals(spark, path)
    assert reports(s, kept) == reports(s) and totals.impossible(kept).isEmpty()
    twice = s.fee_payments.where("enrollment_id = 503")
    kept = totals.fold(totals.fold(kept, totals.FeeChange(payments_out=twice)), totals.FeeChange(payments_out=twice))
    assert sorted((r["total"], r["n"]) for r in totals.impossible(kept).collect()) == [("daily", -1), ("paid", -1)]


def test_reports_from_totals_read_no_payments(spark, base_rows):
    s = money_school(spark, base_rows)
    s.fee_payments.write.parquet(p := fresh())
    kept = totals.count_totals(s)
    broken = s.replace(fee_payments=spark.read.schema(SCHEMAS["fee_payments"]).parquet(p))
    plan = fees.accountant_dashboard(broken, dt.date(2024, 1, 31), kept)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan

"""Acceptance of a batch in order, generated unique values and collated keys."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import D, make_school
from pyspark.sql import functions as F

from rollbook.operators import audit, changes, lifecycle
from rollbook.operators.acceptance import accept_in_order, beaten

DAY = dt.date(2024, 5, 1)
PAYMENT = "enrollment_id long, amount_paid decimal(10,2), payment_date date, payment_mode string, receipt_no string"


def payments(spark, rows):
    return spark.createDataFrame([(e, D(a) if a is not None else None, DAY, m, r) for e, a, m, r in rows], PAYMENT)


def one_by_one(rows):
    """rows: (rank, eligible, values, one or None for each key).  The values that accepted rows hold."""
    held = {}
    for rank, eligible, values in sorted(rows):
        claimed = [(k, v) for k, v in enumerate(values) if v is not None]
        if eligible and not any(c in held for c in claimed):
            held.update({c: rank for c in claimed})
    return held


@pytest.mark.parametrize("seed,kinds", [(1, 3), (2, 12), (3, 40), (4, 400)])
def test_rounds_like_one_row_after_another(spark, seed, kinds):
    rng = random.Random(seed)
    rows = [(i, rng.random() < 0.9, [rng.choice([None, *range(kinds)]) for _ in range(3)]) for i in range(120)]
    claims = spark.createDataFrame([(r, r, e, k, v) for r, e, values in rows for k, v in enumerate(values) if v is not None],
                                   "row long, rank long, eligible boolean, key int, holder long").repartition(4)
    held = one_by_one(rows)
    found = accept_in_order(claims.where("eligible")).collect()
    assert {(r["key"], r["holder"]): r["winner"] for r in found} == held and len(found) == len(held)
    want = {r: sorted(k for k, v in enumerate(values) if held.get((k, v), r) < r) for r, _, values in rows}
    assert {r["row"]: sorted(r["keys"]) for r in beaten(claims).collect()} == {r: k for r, k in want.items() if k}


def test_long_chain_and_no_claims(spark):
    # Row i claims values i and i + 1: every other row is stored, and each waits for the one before.
    claims = spark.createDataFrame([(i, i, 0, i + d) for i in range(9) for d in (0, 1)], "row long, rank long, key int, holder long")
    assert sorted({r["winner"] for r in accept_in_order(claims).collect()}) == [0, 2, 4, 6, 8]
    assert accept_in_order(claims.limit(0)).collect() == []


def test_refused_payment_does_not_hold_its_receipt(spark, base_rows):
    s = make_school(spark, **base_rows)
    batch = payments(spark, [(999, 5, "Cash", "X1"), (501, 5, "Cash", "X1"), (502, 5, "Cash", "X1"), (503, None, "Cash", "X2"), (504, 5, "Cash", "X2")])
    ok, rejected = changes.append_rows(s, "fee_payments", batch.coalesce(1).withColumn("n", F.monotonically_increasing_id()), ["n"])
    assert sorted((r.enrollment_id, r.receipt_no) for r in ok.collect()) == [(501, "X1"), (504, "X2")]
    assert sorted((r.enrollment_id, r.reason) for r in rejected.collect()) == [
        (502, "duplicate_in_batch:receipt_no"), (503, "missing:amount_paid"), (999, "missing_parent:enrollment_id")]


def test_row_refused_for_one_key_does_not_hold_another(spark, base_rows):
    s = make_school(spark, **base_rows)
    # 301 is enrolled in 7002 already, so its claim of roll 7 does not count; 303 takes it, in 7001.
    rows = [(1, 301, 7002, 3002, 7), (2, 303, 7001, 3002, 7), (3, 302, 7001, 3002, 7), (4, 302, 7001, 3003, 9), (5, 302, 7001, 3003, 8)]
    batch = spark.createDataFrame([(*r, DAY) for r in rows], "n int, student_master_id long, academic_year_id long, class_id long, roll_no int, admission_date date")
    ok, rejected = changes.append_rows(s, "student_enrollments", batch, ["n"])
    assert sorted((r.student_master_id, r.class_id, r.roll_no) for r in ok.collect()) == [(302, 3003, 9), (303, 3002, 7)]
    assert sorted((r.n, r.reason) for r in rejected.collect()) == [
        (1, "duplicate_key:student_master_id,academic_year_id"), (3, "duplicate_in_batch:class_id,roll_no"),
        (5, "duplicate_in_batch:student_master_id,academic_year_id")]


def test_admission_in_order_over_two_tables(spark, base_rows):
    s = make_school(spark, **base_rows)
    rows = [("N1", "A", 3001, 1), ("N1", "B", 3001, 50), ("N2", "C", 3001, 50), ("N2", "D", 3001, 51), ("N3", "E", 3001, 51), ("n3", "F", 3002, 60)]
    batch = spark.createDataFrame([(r, f, "Male", n, c, 7002, DAY) for r, f, c, n in rows],
                                  "reg_no string, fname string, gender string, roll_no int, class_id long, academic_year_id long, admission_date date")
    # A's place is taken, so B gets N1 and roll 50; C's N2 is free but roll 50 is not, so D gets N2; E loses 51 to D.
    s2, accepted, rejected = lifecycle.admit_students(s, batch, ["fname"])
    assert sorted(r.fname for r in accepted.collect()) == ["B", "D", "F"]
    assert sorted((r.fname, r.reason) for r in rejected.collect()) == [
        ("A", "duplicate_key:class_id,roll_no"), ("C", "duplicate_in_batch:class_id,roll_no"), ("E", "duplicate_in_batch:class_id,roll_no")]
    assert audit.audit_all_unique(s2).collect() == []
    batch = spark.createDataFrame([("n9", "A", 3001, 70), ("Ñ9", "B", 3001, 71), ("s1", "C", 3001, 72)], "reg_no string, fname string, class_id long, roll_no int").select(
        "reg_no", "fname", F.lit("Male").alias("gender"), "roll_no", "class_id", F.lit(7002).cast("long").alias("academic_year_id"), F.lit(DAY).alias("admission_date"))
    _, accepted, rejected = lifecycle.admit_students(s, batch, ["fname"], collation="UNICODE_CI_AI")
    assert [r.fname for r in accepted.collect()] == ["A"]
    assert sorted((r.fname, r.reason) for r in rejected.collect()) == [("B", "duplicate_in_batch:reg_no"), ("C", "duplicate_key:reg_no")]


def test_closed_years_are_closed_for_admission_update_and_promotion(spark, base_rows):
    s = make_school(spark, **base_rows)
    batch = spark.createDataFrame([("Z1", 3003, 7001), ("Z2", 3001, 7002)], "reg_no string, class_id long, academic_year_id long").select(
        "reg_no", F.lit("Z").alias("fname"), F.lit("Male").alias("gender"), F.lit(33).alias("roll_no"), "class_id", "academic_year_id", F.lit(DAY).alias("admission_date"))
    _, accepted, rejected = lifecycle.admit_students(s, batch, ["reg_no"], enforce_closed=True)
    assert [r.reg_no for r in accepted.collect()] == ["Z2"] and [(r.reg_no, r.reason) for r in rejected.collect()] == [("Z1", "closed_year")]
    assert lifecycle.admit_students(s, batch, ["reg_no"])[1].count() == 2
    moved = spark.createDataFrame([(504, "left"), (501, "left")], "enrollment_id long, status string")
    table, refused = changes.update_table(s, "student_enrollments", moved, enforce_closed=True)
    assert [(r.enrollment_id, r.reason) for r in refused.collect()] == [(504, "closed_year")]
    assert {r.enrollment_id: r.status for r in table.collect()} == {501: "left", 502: "active", 503: "active", 504: "active"}
    people = spark.createDataFrame([("Y1", 3003), ("Y2", 3001)], "reg_no string, class_id long").select(
        F.lit("Y").alias("fname"), F.lit("student").alias("role"), F.lit(DAY).alias("date"), F.lit(None).cast("decimal(10,2)").alias("salary"), F.lit(44).alias("roll_no"), "reg_no", "class_id")
    _, accepted, rejected = lifecycle.register_people(s, people, ["reg_no"], enforce_closed=True)
    assert [r.username for r in accepted.collect()] == ["Y2"] and [(r.reg_no, r.reason) for r in rejected.collect()] == [("Y1", "closed_year")]
    mapping = spark.createDataFrame([(7001, 3003, 7002, 3002), (7002, 3001, 7001, 3003), (7002, 3002, 7002, None)], "from_year long, from_class long, to_year long, to_class long")
    refused = lifecycle.promote(s, mapping, enforce_closed=True)[1]
    assert sorted((r.from_class, r.reason) for r in refused.collect()) == [(3001, "closed_year"), (3003, "closed_year")]


def test_update_refused_for_a_clash_does_not_hold_its_new_place(spark, base_rows):
    s = make_school(spark, **base_rows)
    users = spark.createDataFrame([(10, "ADMIN", "x"), (11, "new", "y"), (20, "NEW", "z")], "user_id long, username string, n string").select("user_id", "username")
    table, refused = changes.update_table(s, "users", users, order_by=["user_id"], collation="UNICODE_CI_AI")
    assert sorted((r.user_id, r.reason) for r in refused.collect()) == [(10, "duplicate_key:username"), (20, "duplicate_in_batch:username")]
    assert {r.user_id: r.username for r in table.collect()}[11] == "new"
    assert changes.update_table(s, "users", users, order_by=["user_id"])[1].count() == 0


def test_generated_receipts_skip_given_and_stored_ones(spark, base_rows):
    stored = [{"payment_id": 5000, "enrollment_id": 501, "amount_paid": 1, "payment_date": "2024-01-01", "receipt_no": "RCP5002"},
              {"payment_id": 4000, "enrollment_id": 501, "amount_paid": 1, "payment_date": "2024-01-01", "receipt_no": "RCP5009"},
              {"payment_id": 4001, "enrollment_id": 501, "amount_paid": 1, "payment_date": "2024-01-01", "receipt_no": "RCPx"},
              {"payment_id": 4002, "enrollment_id": 501, "amount_paid": 1, "payment_date": "2024-01-01", "receipt_no": "RCP" + "9" * 40}]
    s = make_school(spark, **base_rows, fee_payments=stored)
    batch = payments(spark, [(501, 1, None, "RCP5003"), (501, 2, None, None), (502, 3, None, None), (503, 4, None, None)])
    ok, rejected = changes.append_rows(s, "fee_payments", batch, ["amount_paid"], generate={"receipt_no": "RCP"})
    # Ids 5001 to 5004; 5002 and 5003 are taken as numbers, 5009 is the largest number.
    assert sorted((r.payment_id, r.receipt_no) for r in ok.collect()) == [(5001, "RCP5003"), (5002, "RCP5010"), (5003, "RCP5011"), (5004, "RCP5004")]
    assert rejected.count() == 0 and audit.audit_all_unique(changes.append(s, "fee_payments", ok)).collect() == []


def test_collated_keys(spark, base_rows):
    s = make_school(spark, **base_rows)
    users = spark.createDataFrame([("s1", "student"), ("José", "student"), ("JOSE", "student"), ("Ann", "student")], "username string, role string")
    ok, rejected = changes.append_rows(s, "users", users.coalesce(1).withColumn("n", F.monotonically_increasing_id()), ["n"], collation="UNICODE_CI_AI")
    assert sorted(r.username for r in ok.collect()) == ["Ann", "José"]
    assert sorted((r.username, r.reason) for r in rejected.collect()) == [("JOSE", "duplicate_in_batch:username"), ("s1", "duplicate_key:username")]
    assert changes.append_rows(s, "users", users, ["username"])[0].count() == 4


def test_search_for_a_table_of_keywords(spark):
    from rollbook.operators import people
    names = ["Maths", "Mathematics 2", "Art", "", None, "50%_off", "naïve Ärt", "aaa", "MATHS"]
    rows = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "id int, name string, _gram string")
    words = ["math", "A", "ar", "ärt", "", None, "%_", "_", "zzz", "aaaa", "aaa", "mathematics 2", "s", "Maths", "maths", "maths", "50% off"]
    found = people.search_keywords(rows.repartition(3), "name", spark.createDataFrame([(w,) for w in words], "keyword string"))
    want = sorted((w, i) for w in {w for w in words if w is not None} for i, n in enumerate(names) if n is not None and w.lower() in n.lower())
    assert sorted((r.keyword, r.id) for r in found.collect()) == want and found.columns == ["keyword", "id", "name", "_gram"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and all("Join Inner, (" in line or "LeftSemi" in line or "LeftOuter" in line for line in plan.splitlines() if "Join " in line)
    assert people.search_keywords(rows, "name", spark.createDataFrame([], "keyword string")).collect() == []


def test_names_looked_up_under_a_collation(spark, base_rows):
    from rollbook.operators import people
    s = make_school(spark, **base_rows)
    wanted = spark.createDataFrame([("ÁDMIN",), ("s1",), ("S9",)], "username string")
    assert sorted(people.users_exist(s, wanted, "UNICODE_CI_AI").collect()) == [("S9", 0), ("s1", 1), ("ÁDMIN", 1)]
    assert sorted(people.users_exist(s, wanted).collect()) == [("S9", 0), ("s1", 0), ("ÁDMIN", 0)]
    same = s.users.select("username").unionByName(wanted)
    assert sorted(audit.audit_unique(same, ["username"], "UNICODE_CI_AI").collect()) == [("S1", 2), ("admin", 2)]
    assert audit.audit_unique(same, ["username"]).collect() == []

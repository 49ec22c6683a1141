"""Plan regressions: the properties that matter at scale, checked on the Parquet layout
with Spark's automatic broadcast thresholds off."""

from __future__ import annotations

import re
import tempfile

import pytest

from conftest import SF_SMALL
from pyspark.sql import functions as F
from rollbook.operators import acceptance, changes, fees, lifecycle, marks, people
from rollbook.sources.fixtures import derive_school
from rollbook.sources.store import read_school, write_school


@pytest.fixture(scope="module")
def stored(spark):
    path = tempfile.mkdtemp(prefix="run-plans-", dir="/tmp") + "/school"
    write_school(derive_school(spark, SF_SMALL), path, files_per_table=2)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "-1")
    yield read_school(spark, path)
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_active_year_prunes_enrollment_partitions(stored):
    stored.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")  # as a file of years would be
    p = plan(fees.defaulters(stored))
    stored.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    scan = [line for line in p.splitlines() if "FileScan parquet" in line and "student_enrollments" in line][0]
    assert "dynamicpruning" in scan


def test_facts_are_pre_aggregated_before_the_shuffle(stored):
    p = plan(fees.class_wise_fees(stored))
    assert "partial_sum(amount_paid" in p and "partial_sum(total_amount" in p
    p = plan(marks.class_performance(stored))
    # decimal(5,2) sums run on unscaled longs: partial_sum(UnscaledValue(marks_obtained …))
    assert re.search(r"partial_sum\((UnscaledValue\()?marks_obtained", p)


def test_no_fact_or_student_table_is_broadcast(stored):
    for df in (fees.fee_status(stored), fees.defaulters(stored), marks.class_performance(stored)):
        p = plan(df)
        for exch in p.split("BroadcastExchange")[1:]:
            head = exch.split("BroadcastExchange")[0]
            first_scan = head[head.find("FileScan parquet"):][:400]
            for big in ("fee_payments", "marks]", "student_master", "student_fee_assignments"):
                assert big not in first_scan


def test_top_k_is_limited_before_shuffles(stored):
    assert "WindowGroupLimit" in plan(marks.top_students(stored, None, 10))
    p = plan(fees.recent_transactions(stored, 50))
    assert "TakeOrderedAndProject" in p


def test_scans_read_only_used_columns(stored):
    p = plan(fees.payment_modes(stored, __import__("datetime").date(2000, 6, 15)))
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "receipt_no" not in scan and "payment_date" in scan and "PushedFilters: [IsNotNull(payment_date), " \
        "GreaterThanOrEqual(payment_date" in scan


def test_one_year_reports_keep_facts_to_their_enrollments_first(stored):
    for df, fact in ((fees.fee_status(stored), "fee_payments"), (fees.class_wise_fees(stored), "student_fee_assignments"),
                     (marks.class_performance(stored), "marks"), (marks.student_dashboard(stored), "attendance_students")):
        assert re.search(rf"(?s)LeftSemi.*{fact}", plan(df))


def test_building_a_report_starts_no_job(stored):
    tracker = stored.spark.sparkContext.statusTracker()
    stored.spark.sparkContext.setJobGroup("reports-being-built", "no job")
    for build in (fees.fee_status, fees.defaulters, fees.class_wise_fees, marks.class_performance, marks.teacher_dashboard):
        build(stored)
    assert list(tracker.getJobIdsForGroup("reports-being-built")) == []
    stored.spark.sparkContext.setJobGroup("", "")


def test_all_key_audits_read_each_table_once(spark, tmp_path):
    from rollbook.operators import audit
    from rollbook.sources.store import read_school, write_school
    write_school(derive_school(spark, SF_SMALL), str(tmp_path / "school"))
    s = read_school(spark, str(tmp_path / "school"))
    for df in (audit.audit_all_unique(s), audit.audit_all_foreign_keys(s)):
        plan = df._jdf.queryExecution().optimizedPlan()
        assert plan.collectLeaves().size() == 13 and "Join" not in plan.toString()


def test_derived_facts_and_students_are_merged_by_key(spark):
    # With Spark's own thresholds: files of customers are small, their rows of all years are not.
    s = derive_school(spark, SF_SMALL)
    assert "BroadcastExchange" not in plan(s.fee_payments) and "BroadcastExchange" not in plan(s.attendance_students)
    for df in (fees.recent_transactions(s), people.students_by_year(s, match_year=False), fees.fee_status(s)):
        p = plan(df)
        # Students and facts are merged; what is joined to classes and years is never the side sent.
        assert "SortMergeJoin" in p and "BuildLeft" not in p


def test_table_changes_merge_their_rows_by_key(spark):
    s = derive_school(spark, SF_SMALL)
    enr = s.student_enrollments
    p = plan(changes.update_rows(enr, enr.select("enrollment_id", "status"), "enrollment_id"))
    assert "SortMergeJoin" in p and "BroadcastExchange" not in p


def sent(df) -> set[str]:
    """The columns of all relations that the plan of ``df`` broadcasts."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    relations = re.findall(r"BroadcastExchange\s*\nInput \[\d+\]: \[(.*?)\]", text)
    assert len(relations) == len(re.findall(r"\) BroadcastExchange\s*\nInput", text))
    return {re.sub(r"#\d+L?", "", c) for r in relations for c in r.split(", ")}


def test_batches_send_no_rows_of_students_to_the_driver(spark, monkeypatch):
    # Without checkpoints the plan shows every join of a change, with Spark's own thresholds.
    for module in (acceptance, changes):
        monkeypatch.setattr(module, "cut_lineage", lambda df: df)
    s = derive_school(spark, SF_SMALL)
    enr, c = s.student_enrollments, s.classes
    left = enr.select("enrollment_id", F.lit("left").alias("status"))
    paid = enr.select("enrollment_id", F.lit(7).cast("decimal(10,2)").alias("amount_paid"), F.lit("2020-01-01").cast("date").alias("payment_date"))
    given = paid.withColumn("receipt_no", F.when(F.col("enrollment_id") % 3 == 0, F.concat(F.lit("RCP"), F.col("enrollment_id").cast("string"))))
    mapped = c.select(F.col("academic_year_id").alias("from_year"), F.col("class_id").alias("from_class"),
                      F.col("academic_year_id").alias("to_year"), F.lit(None).cast("long").alias("to_class"))
    claims = enr.select(F.struct("enrollment_id").alias("row"), F.struct("enrollment_id").alias("rank"), F.lit(True).alias("eligible"),
                        F.lit(0).alias("key"), F.struct("class_id").alias("holder"))
    for df in (*changes.update_table(s, "student_enrollments", left, enforce_closed=True), acceptance.beaten(claims),
               changes.append_rows(s, "fee_payments", paid, ["enrollment_id"])[0],
               changes.append_rows(s, "fee_payments", given, ["enrollment_id"], generate={"receipt_no": "RCP"})[0],
               lifecycle.promote(s, mapped)[1]):
        assert not sent(df) & {"enrollment_id", "student_master_id", "o_custkey", "payment_id", "receipt_no", "row", "holder", "_row", "_k0"}


def test_audits_group_by_numbers_and_one_text(spark):
    from conftest import make_school
    from rollbook.operators import audit
    s = make_school(spark, exams=[dict(exam_id=1, exam_name="a|1", academic_year_id=2), dict(exam_id=2, exam_name="a", academic_year_id=12),
                                  dict(exam_id=3, exam_name="a|1", academic_year_id=2), dict(exam_id=3, exam_name="b", academic_year_id=2)])
    unique = audit.audit_all_unique(s)
    assert sorted(map(tuple, unique.collect())) == [("exams", "exam_id", "3", 2), ("exams", "exam_name,academic_year_id", "a|1|2", 2)]
    assert sorted(map(tuple, audit.audit_all_foreign_keys(s).collect())) == [
        ("exams", "academic_year_id", "academic_years", 2, 3), ("exams", "academic_year_id", "academic_years", 12, 1)]
    # A group is as small as it can be: no arrays, no names, no count for references to other parents.
    assert re.search(r"Aggregate \[rule#\d+, value#\d+\]", unique._jdf.queryExecution().optimizedPlan().toString())
    assert re.search(r"keys=\[parent#\d+, value#\d+L\]", plan(audit.audit_all_foreign_keys(s)))


def test_enrollments_and_slots_of_marks_are_dealt_over_all_tasks(spark):
    # By a given number, which Spark does not join to fewer: no task holds the groups of many millions of rows.
    n = spark.conf.get("spark.sql.shuffle.partitions")
    s = derive_school(spark, SF_SMALL)
    assert re.search(rf"(?s)Generate explode.*hashpartitioning\(c_custkey#\d+L, {n}\), REPARTITION_BY_NUM", plan(s.student_enrollments))
    p = plan(s.marks)
    assert re.search(rf"hashpartitioning\(enrollment_id#\d+L, {n}\), REPARTITION_BY_NUM", p)
    # The groups are counted where they are dealt to: partial and whole maxima in one stage.
    assert p.find("partial_max") < p.find("REPARTITION_BY_NUM") and p.count("hashpartitioning(enrollment_id") == 1


def test_fees_are_sent_to_enrollments_by_one_number(spark, tmp_path):
    rows = {"customer": ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string",
                         [(k, f"C{k}", 1, "M") for k in (0, 1, 2, 2, 9, 29)] + [(None, "C", 1, "M")]),
            "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", []),
            "orders": ("o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", []),
            "lineitem": ("l_orderkey long, l_partkey long, l_linenumber int, l_quantity double", []),
            "events": ("ts timestamp_ntz, user_id long, event_type string", [])}
    for name, (kind, values) in rows.items():
        spark.createDataFrame(values, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    fees_assigned = derive_school(spark, str(tmp_path)).student_fee_assignments
    # Two keys do not fit a long: their relation takes a memory page in the driver for every job that reads fees.
    sent = re.findall(r"BroadcastExchange HashedRelationBroadcastMode\(List\((.*?)\),", plan(fees_assigned))
    assert len(sent) == 1 and sent[0].count("input[") == 1
    want = []
    for k in (0, 1, 2, 2, 9, 29):
        for y in range(7):
            e, level = 501 + 7 * k + y, (k + y) % 10 + 1
            if (k + y) % 4 != 3 and e % 9 and (y, level) != (5, 10):
                want += [(2 * e + copy, e, 40000 + 30000 * level, f"{1995 + y}-01-01") for copy in range(2 if e % 50 == 1 else 1)]
    assert sorted((a, e, int(t), str(d)) for a, e, t, d in fees_assigned.collect()) == sorted(want)

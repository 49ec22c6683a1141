"""Invariants on the fixture school: table changes keep every declared rule (Q1–Q3)."""

from __future__ import annotations

import pytest

from conftest import SF_SMALL, make_school
from rollbook.operators import audit, changes, lifecycle, marks
from rollbook.plans.registry_changes import _attendance_batch, _fee_batch, _payment_batch
from rollbook.plans.registry_lifecycle import admission_batch, marks_batch, rollover
from rollbook.sources.fixtures import derive_school


@pytest.fixture(scope="module")
def school(spark):
    return derive_school(spark, SF_SMALL)


def _clean(s):
    assert audit.audit_all_unique(s).count() == 0
    assert audit.audit_all_foreign_keys(s).count() == 0
    bad = [(r.table_name, r.rule, r.violations) for r in audit.audit_all_values(s).collect() if r.violations]
    assert bad == []


def test_fixture_school_is_clean(school):
    _clean(school)


def test_changes_keep_declared_rules(school):
    acc, _ = changes.append_rows(school, "fee_payments", _payment_batch(school), ["enrollment_id"],
                                 fill={"receipt_no": changes.payment_receipt()})
    s = changes.append(school, "fee_payments", acc)
    s = s.replace(student_fee_assignments=changes.assign_fees(s, _fee_batch(s), "upsert")[0])
    s = s.replace(attendance_students=changes.mark_attendance(s, _attendance_batch(s))[0])
    s, _, _ = lifecycle.add_marks(s, marks_batch(s))
    s, _, _ = lifecycle.admit_students(s, admission_batch(s), ["reg_no"])
    _clean(s)


def test_rollover_keeps_declared_rules(school, spark):
    enr, refused = rollover(school)
    assert refused.count() == 0
    # The promoted school: new year and classes from the roll-over are part of the check.
    latest = school.academic_years.agg({"academic_year_id": "max"}).first()[0]
    assert enr.where(f"academic_year_id = {latest + 1}").count() > 0
    assert audit.audit_unique(enr, ["class_id", "roll_no"]).count() == 0
    assert audit.audit_unique(enr, ["student_master_id", "academic_year_id"]).count() == 0
    assert audit.audit_values(enr, "student_enrollments").where("violations > 0").count() == 0


def test_upsert_fee_structure_is_idempotent(school, spark):
    from rollbook.plans.registry_changes import _structure_batch
    once, _ = changes.upsert_fee_structure(school, _structure_batch(school))
    twice, _ = changes.upsert_fee_structure(school.replace(fee_structures=once), _structure_batch(school))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_dashboard_class_without_subjects_has_null_list(spark, base_rows):
    rows = dict(base_rows)
    rows["student_enrollments"] = [dict(r, user_id=22) if r["enrollment_id"] == 503 else r
                                   for r in base_rows["student_enrollments"]]
    d = {r.enrollment_id: r for r in marks.student_dashboard(make_school(spark, **rows)).collect()}
    assert d[503].subjects is None and d[503].total_days == 0 and d[503].class_teacher is None

"""Registered table changes (W1–W8) with DuckDB oracles.

Change batches are derived from the tables by rules on the data (every
active-year enrollment, every teacher, …), so they grow with the input.
A change's entry returns the changed table, or for appends the accepted
(or rejected) rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rollbook.catalog import AS_OF, REGISTRY, register
from rollbook.operators import changes, fees, lifecycle, stored, totals
from rollbook.plans.dims import by_key, fresh_folder, in_active_year

ATTENDANCE_DAY = dt.date(2024, 1, 15)

_ACTIVE_ENR = """
  FROM student_enrollments se JOIN academic_years ay ON ay.academic_year_id = se.academic_year_id
 WHERE ay.is_active
"""


# New payments for every active-year enrollment; some rows are refused.
def _payment_batch(s):
    enr = in_active_year(s.student_enrollments, s.academic_years)
    r = F.col("roll_no")
    return enr.select(
        F.when(r % 13 == 0, -F.col("enrollment_id")).otherwise(F.col("enrollment_id")).alias("enrollment_id"),
        F.when(r % 10 == 0, F.lit(None)).otherwise(1000 + (r % 7) * 250).cast("decimal(10,2)").alias("amount_paid"),
        F.lit(AS_OF).alias("payment_date"),
        F.when(r % 3 == 0, F.lit(None)).otherwise(F.lit("UPI")).alias("payment_mode"))


def _append_payments(s):
    return changes.append_rows(s, "fee_payments", _payment_batch(s), ["enrollment_id"],
                               fill={"receipt_no": changes.payment_receipt()})


_PAYMENT_BATCH_SQL = f"""
, batch AS (
  SELECT CASE WHEN se.roll_no % 13 = 0 THEN -se.enrollment_id ELSE se.enrollment_id END AS enrollment_id,
         CASE WHEN se.roll_no % 10 = 0 THEN NULL
              ELSE CAST(1000 + (se.roll_no % 7) * 250 AS DECIMAL(10,2)) END AS amount_paid,
         DATE '{AS_OF}' AS payment_date,
         CASE WHEN se.roll_no % 3 = 0 THEN NULL ELSE 'UPI' END AS payment_mode
  {_ACTIVE_ENR}
), checked AS (
  SELECT *, CASE WHEN amount_paid IS NULL THEN 'missing:amount_paid'
                 WHEN enrollment_id NOT IN (SELECT enrollment_id FROM student_enrollments)
                   THEN 'missing_parent:enrollment_id' END AS reason
    FROM batch
)
"""

register("append_payments", _PAYMENT_BATCH_SQL + """
, ok AS (
  SELECT (SELECT max(payment_id) FROM fee_payments) + row_number() OVER (ORDER BY enrollment_id) AS payment_id,
         enrollment_id, amount_paid, payment_date, coalesce(payment_mode, 'Cash') AS payment_mode
    FROM checked WHERE reason IS NULL
)
SELECT payment_id, enrollment_id, CAST(amount_paid AS DOUBLE) AS amount_paid, payment_date, payment_mode,
       'RCP' || CAST(payment_id AS VARCHAR) AS receipt_no
  FROM ok
""")(lambda s: _append_payments(s)[0])

register("append_payments_rejected", _PAYMENT_BATCH_SQL + """
SELECT enrollment_id, reason FROM checked WHERE reason IS NOT NULL
""")(lambda s: _append_payments(s)[1].select("enrollment_id", "reason"))


# W1, subject form: a 'Computing' subject for every class of the latest year, taught by the
# class teacher (classes without one are refused: teacher_id is NOT NULL).
def _subject_batch(s):
    latest = s.academic_years.agg(F.max("academic_year_id").alias("academic_year_id"))
    return (s.classes.join(latest, "academic_year_id", "left_semi")
            .select(F.lit("Computing").alias("subject_name"), "class_id",
                    F.col("class_teacher_id").alias("teacher_id"), "academic_year_id"))


def _append_subjects(s):
    return changes.append_rows(s, "subjects", _subject_batch(s), ["class_id"])


_SUBJECT_BATCH_SQL = """
, batch AS (
  SELECT 'Computing' AS subject_name, class_id, class_teacher_id AS teacher_id, academic_year_id
    FROM classes WHERE academic_year_id = (SELECT max(academic_year_id) FROM academic_years)
)
"""

register("append_subjects", _SUBJECT_BATCH_SQL + """
SELECT (SELECT max(subject_id) FROM subjects) + row_number() OVER (ORDER BY class_id) AS subject_id,
       subject_name, class_id, teacher_id, academic_year_id
  FROM batch WHERE teacher_id IS NOT NULL
""")(lambda s: _append_subjects(s)[0])

register("append_subjects_rejected", _SUBJECT_BATCH_SQL + """
SELECT class_id, 'missing:teacher_id' AS reason FROM batch WHERE teacher_id IS NULL
""")(lambda s: _append_subjects(s)[1].select("class_id", "reason"))


# W1, single fee assignment form: every active-year enrollment without an assignment gets
# 1000 per level, assigned on as_of.
def _fee_assignment_batch(s):
    enr = in_active_year(s.student_enrollments, s.academic_years).select("enrollment_id", "class_id")
    missing = enr.join(by_key(s.student_fee_assignments.select("enrollment_id")), "enrollment_id", "left_anti")
    return (missing.join(F.broadcast(s.classes.select("class_id", "class_level")), "class_id")
            .select("enrollment_id", (1000 * F.col("class_level")).cast("decimal(10,2)").alias("total_amount"),
                    F.lit(AS_OF).alias("assigned_date")))


register("append_fee_assignment", f"""
, batch AS (
  SELECT se.enrollment_id, CAST(1000 * c.class_level AS DECIMAL(10,2)) AS total_amount
    FROM student_enrollments se JOIN academic_years ay ON ay.academic_year_id = se.academic_year_id
    JOIN classes c ON c.class_id = se.class_id
   WHERE ay.is_active AND se.enrollment_id NOT IN (SELECT enrollment_id FROM student_fee_assignments)
)
SELECT (SELECT max(assignment_id) FROM student_fee_assignments) + row_number() OVER (ORDER BY enrollment_id)
         AS assignment_id,
       enrollment_id, CAST(total_amount AS DOUBLE) AS total_amount, DATE '{AS_OF}' AS assigned_date
  FROM batch
""")(lambda s: changes.append_rows(s, "student_fee_assignments", _fee_assignment_batch(s),
                                   ["enrollment_id"])[0])


# W1, payment with a given receipt: receipt numbers repeat inside the batch and some are
# already taken, so both duplicate rules are exercised.
def _receipt_batch(s):
    enr = in_active_year(s.student_enrollments, s.academic_years)
    return enr.select("enrollment_id", F.lit(500).cast("decimal(10,2)").alias("amount_paid"),
                      F.lit(AS_OF).alias("payment_date"), F.lit("Bank").alias("payment_mode"),
                      F.concat(F.lit("RCP"), (F.col("enrollment_id") % 1000).cast("string")).alias("receipt_no"))


def _append_receipts(s):
    return changes.append_rows(s, "fee_payments", _receipt_batch(s), ["enrollment_id"])


_RECEIPT_BATCH_SQL = f"""
, batch AS (
  SELECT se.enrollment_id, 'RCP' || CAST(se.enrollment_id % 1000 AS VARCHAR) AS receipt_no
  {_ACTIVE_ENR}
), checked AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY receipt_no ORDER BY enrollment_id) > 1
                   THEN 'duplicate_in_batch:receipt_no'
                 WHEN receipt_no IN (SELECT receipt_no FROM fee_payments) THEN 'duplicate_key:receipt_no'
            END AS reason
    FROM batch
)
"""

register("append_payments_given_receipt", _RECEIPT_BATCH_SQL + f"""
SELECT (SELECT max(payment_id) FROM fee_payments) + row_number() OVER (ORDER BY enrollment_id) AS payment_id,
       enrollment_id, CAST(500 AS DOUBLE) AS amount_paid, DATE '{AS_OF}' AS payment_date, 'Bank' AS payment_mode, receipt_no
  FROM checked WHERE reason IS NULL
""")(lambda s: _append_receipts(s)[0])

register("append_payments_given_receipt_rejected", _RECEIPT_BATCH_SQL + """
SELECT enrollment_id, reason FROM checked WHERE reason IS NOT NULL
""")(lambda s: _append_receipts(s)[1].select("enrollment_id", "reason"))


# Keyed updates.
def _teacher_raise(s):
    teachers = s.users.where(F.col("role") == "teacher").select("user_id")
    ch = (s.employees.join(teachers, "user_id", "left_semi")
          .select("employee_id", F.round(F.col("salary") * F.lit(1.1).cast("decimal(2,1)"), 2)
                  .cast("decimal(10,2)").alias("salary")))
    return changes.update_rows(s.employees, ch, "employee_id")


register("update_salary", """
SELECT e.employee_id, e.user_id, e.fname, e.lname, e.reg_no, e.gender, e.mobile, e.email, e.joining_date,
       CAST(CASE WHEN u.role = 'teacher' THEN CAST(round(e.salary * 1.1, 2) AS DECIMAL(10,2))
                 ELSE e.salary END AS DOUBLE) AS salary
  FROM employees e JOIN users u ON u.user_id = e.user_id
""")(_teacher_raise)


def _teacher_status(s):
    # Every employee login is sent 'inactive', but only rows with role 'teacher' may change.
    ch = s.employees.select("user_id", F.lit("inactive").alias("status"))
    return changes.update_rows(s.users, ch, "user_id", where=F.col("role") == "teacher")


register("change_teacher_status", """
SELECT user_id, username, role,
       CASE WHEN role = 'teacher' AND user_id IN (SELECT user_id FROM employees) THEN 'inactive'
            ELSE status END AS status,
       created_at
  FROM users
""")(_teacher_status)


def _deactivate_negative_salary(s):
    keys = s.employees.where(F.col("salary") < 0).select("user_id")
    return changes.set_columns(s.users, keys, "user_id", {"status": "inactive"})


register("set_user_status", """
SELECT user_id, username, role,
       CASE WHEN user_id IN (SELECT user_id FROM employees WHERE salary < 0) THEN 'inactive' ELSE status END
         AS status,
       created_at
  FROM users
""")(_deactivate_negative_salary)


def _close_active_years(s):
    return changes.set_columns(s.academic_years, s.academic_years.where(F.col("is_active")),
                               "academic_year_id", {"is_closed": True})


register("close_years", """
SELECT academic_year_id, year_name, start_date, end_date, is_active, is_active OR is_closed AS is_closed,
       created_at
  FROM academic_years
""")(_close_active_years)


def _assign_class_teachers(s):
    # Every class without a class teacher gets the teacher of its first subject.
    first = s.subjects.groupBy("class_id").agg(F.min("subject_id").alias("subject_id"))
    ch = (s.classes.where(F.col("class_teacher_id").isNull()).select("class_id")
          .join(first, "class_id").join(s.subjects.select("subject_id", "teacher_id"), "subject_id")
          .select("class_id", F.col("teacher_id").alias("class_teacher_id")))
    return changes.update_rows(s.classes, ch, "class_id")


register("assign_class_teacher", """
SELECT c.class_id, c.class_level, c.division, c.academic_year_id,
       CASE WHEN c.class_teacher_id IS NULL
            THEN (SELECT s.teacher_id FROM subjects s WHERE s.class_id = c.class_id ORDER BY s.subject_id LIMIT 1)
            ELSE c.class_teacher_id END AS class_teacher_id
  FROM classes c
""")(_assign_class_teachers)


def _move_left_students(s):
    # Students who left get roll numbers past the class's range (class unchanged).
    ch = s.student_enrollments.where(F.col("status") == "left").select(
        "enrollment_id", "class_id", (F.col("roll_no") + 1000000).alias("roll_no"))
    return changes.update_rows(s.student_enrollments, ch, "enrollment_id")


register("change_class_roll", """
SELECT enrollment_id, student_master_id, academic_year_id, class_id,
       CASE WHEN status = 'left' THEN roll_no + 1000000 ELSE roll_no END AS roll_no,
       admission_date, user_id, status
  FROM student_enrollments
""")(_move_left_students)


def _subject_teacher(s):
    # Every subject taught by an employee whose login is inactive goes to the class's teacher.
    inactive = s.users.where(F.col("status") == "inactive").select("user_id")
    gone = s.employees.join(inactive, "user_id", "left_semi").select(F.col("employee_id").alias("teacher_id"))
    ch = (s.subjects.join(gone, "teacher_id", "left_semi").select("subject_id", "class_id")
          .join(s.classes.where(F.col("class_teacher_id").isNotNull()).select("class_id", "class_teacher_id"),
                "class_id")
          .select("subject_id", F.col("class_teacher_id").alias("teacher_id")))
    return changes.update_rows(s.subjects, ch, "subject_id")


register("change_subject_teacher", """
, gone AS (SELECT e.employee_id FROM employees e JOIN users u ON u.user_id = e.user_id WHERE u.status = 'inactive')
SELECT s.subject_id, s.subject_name, s.class_id,
       CASE WHEN s.teacher_id IN (SELECT employee_id FROM gone) AND c.class_teacher_id IS NOT NULL
            THEN c.class_teacher_id ELSE s.teacher_id END AS teacher_id,
       s.academic_year_id
  FROM subjects s JOIN classes c ON c.class_id = s.class_id
""")(_subject_teacher)


def _employee_profile(s):
    # Every employee updates their own profile by login: upper-case last name, new mobile and e-mail.
    ch = s.employees.select("user_id", "fname", F.upper("lname").alias("lname"), "gender",
                            F.concat(F.lit("P"), F.col("employee_id").cast("string")).alias("mobile"),
                            F.concat(F.col("reg_no"), F.lit("@school")).alias("email"))
    return changes.update_rows(s.employees, ch, "user_id")


register("update_employee_profile", """
SELECT employee_id, user_id, fname, upper(lname) AS lname, reg_no, gender,
       'P' || CAST(employee_id AS VARCHAR) AS mobile, reg_no || '@school' AS email, joining_date,
       CAST(salary AS DOUBLE) AS salary
  FROM employees
""")(_employee_profile)


def _role_change(s):
    # Accountants with a negative salary become teachers.
    keys = (s.employees.where(F.col("salary") < 0).select("user_id")
            .join(s.users.where(F.col("role") == "accountant"), "user_id", "left_semi"))
    return changes.set_columns(s.users, keys, "user_id", {"role": "teacher"})


register("set_user_role", """
SELECT user_id, username,
       CASE WHEN role = 'accountant' AND user_id IN (SELECT user_id FROM employees WHERE salary < 0)
            THEN 'teacher' ELSE role END AS role,
       status, created_at
  FROM users
""")(_role_change)


# Contact change of every student whose login is inactive.
def _contact_changes(s):
    u = s.users.where((F.col("role") == "student") & (F.col("status") == "inactive"))
    ch = u.select("user_id", F.concat(F.lit("X"), F.col("user_id").cast("string")).alias("mobile"),
                  F.lit(None).cast("string").alias("email"), F.lit("moved").alias("address"))
    return changes.update_student_contact(s, ch)[0]


register("update_student_contact", f"""
, moved AS (
  SELECT DISTINCT se.student_master_id, se.user_id
    FROM student_enrollments se JOIN academic_years ay ON ay.academic_year_id = se.academic_year_id
    JOIN users u ON u.user_id = se.user_id
   WHERE ay.is_active AND u.role = 'student' AND u.status = 'inactive'
)
SELECT sm.student_master_id, sm.reg_no, sm.fname, sm.lname, sm.mother_name, sm.gender, sm.dob,
       CASE WHEN m.user_id IS NULL THEN sm.mobile ELSE 'X' || CAST(m.user_id AS VARCHAR) END AS mobile,
       CASE WHEN m.user_id IS NULL THEN sm.email ELSE NULL END AS email,
       CASE WHEN m.user_id IS NULL THEN sm.address ELSE 'moved' END AS address,
       sm.created_at
  FROM student_master sm LEFT JOIN moved m ON m.student_master_id = sm.student_master_id
""")(_contact_changes)


# Toggle every active-year enrollment whose login is inactive.
def _toggle(s):
    inactive = s.users.where(F.col("status") == "inactive").select("user_id")
    keys = in_active_year(s.student_enrollments, s.academic_years).join(by_key(inactive), "user_id", "left_semi")
    return changes.toggle_status(s.student_enrollments, keys)


register("toggle_status", """
, keys AS (
  SELECT se.enrollment_id FROM student_enrollments se
    JOIN academic_years ay ON ay.academic_year_id = se.academic_year_id
    JOIN users u ON u.user_id = se.user_id
   WHERE ay.is_active AND u.status = 'inactive'
)
SELECT enrollment_id, student_master_id, academic_year_id, class_id, roll_no, admission_date, user_id,
       CASE WHEN enrollment_id IN (SELECT enrollment_id FROM keys)
            THEN CASE WHEN status = 'active' THEN 'left' ELSE 'active' END ELSE status END AS status
  FROM student_enrollments
""")(_toggle)


# A new fee for every active-year enrollment.
def _fee_batch(s):
    enr = in_active_year(s.student_enrollments, s.academic_years).select("enrollment_id", "class_id")
    return (enr.join(F.broadcast(s.classes.select("class_id", "class_level")), "class_id")
            .select("enrollment_id", (50000 + 1000 * F.col("class_level")).cast("decimal(10,2)").alias("total_amount"),
                    F.lit(AS_OF).alias("assigned_date")))


_FEE_BATCH_SQL = f"""
, batch AS (
  SELECT se.enrollment_id, CAST(50000 + 1000 * c.class_level AS DECIMAL(10,2)) AS total_amount,
         DATE '{AS_OF}' AS assigned_date
    FROM student_enrollments se JOIN academic_years ay ON ay.academic_year_id = se.academic_year_id
    JOIN classes c ON c.class_id = se.class_id
   WHERE ay.is_active
)
"""

register("assign_fees", _FEE_BATCH_SQL + """
SELECT a.assignment_id, a.enrollment_id, CAST(coalesce(b.total_amount, a.total_amount) AS DOUBLE) AS total_amount,
       coalesce(b.assigned_date, a.assigned_date) AS assigned_date
  FROM student_fee_assignments a LEFT JOIN batch b ON b.enrollment_id = a.enrollment_id
UNION ALL
SELECT (SELECT max(assignment_id) FROM student_fee_assignments)
         + row_number() OVER (ORDER BY b.enrollment_id, b.total_amount),
       b.enrollment_id, CAST(b.total_amount AS DOUBLE), b.assigned_date
  FROM batch b WHERE b.enrollment_id NOT IN (SELECT enrollment_id FROM student_fee_assignments)
""")(lambda s: changes.assign_fees(s, _fee_batch(s), "upsert")[0])

register("assign_fees_append", _FEE_BATCH_SQL + """
SELECT assignment_id, enrollment_id, CAST(total_amount AS DOUBLE) AS total_amount, assigned_date
  FROM student_fee_assignments
UNION ALL
SELECT (SELECT max(assignment_id) FROM student_fee_assignments)
         + row_number() OVER (ORDER BY b.enrollment_id, b.total_amount),
       b.enrollment_id, CAST(b.total_amount AS DOUBLE), b.assigned_date
  FROM batch b
""")(lambda s: changes.assign_fees(s, _fee_batch(s), "append")[0])

def _bulk_class_fees(s):
    # The bulk form appends (its ON DUPLICATE KEY never matches): level-10 classes of the active
    # year, which have no fee structure, get 60000 each.
    cls = in_active_year(s.classes, s.academic_years).where(F.col("class_level") == 10).select("class_id")
    return changes.assign_fees(s, changes.class_fee_flat_batch(s, cls, 60000, AS_OF), "append")[0]


register("assign_fees_bulk", f"""
, batch AS (
  SELECT se.enrollment_id FROM student_enrollments se
    JOIN academic_years ay ON ay.academic_year_id = se.academic_year_id
    JOIN classes c ON c.class_id = se.class_id
   WHERE ay.is_active AND c.class_level = 10 AND c.academic_year_id = se.academic_year_id
)
SELECT assignment_id, enrollment_id, CAST(total_amount AS DOUBLE) AS total_amount, assigned_date
  FROM student_fee_assignments
UNION ALL
SELECT (SELECT max(assignment_id) FROM student_fee_assignments) + row_number() OVER (ORDER BY enrollment_id),
       enrollment_id, CAST(60000 AS DOUBLE), DATE '{AS_OF}'
  FROM batch
""")(_bulk_class_fees)

register("dedupe_assignments", """
SELECT assignment_id, enrollment_id, CAST(total_amount AS DOUBLE) AS total_amount, assigned_date
  FROM student_fee_assignments
 WHERE assignment_id IN (SELECT min(assignment_id) FROM student_fee_assignments GROUP BY enrollment_id)
""")(lambda s: changes.dedupe_assignments(s.student_fee_assignments))


# Fees of every active-year class from the active year's structure.
def _class_fees(s):
    cls = in_active_year(s.classes, s.academic_years).select("class_id")
    year = s.academic_years.where(F.col("is_active")).agg(F.max("academic_year_id")).scalar()
    return changes.assign_class_fees(s, year, cls, AS_OF)[0]


register("assign_class_fees", f"""
SELECT (SELECT max(assignment_id) FROM student_fee_assignments)
         + row_number() OVER (ORDER BY se.enrollment_id) AS assignment_id,
       se.enrollment_id, CAST(fs.total_amount AS DOUBLE) AS total_amount, DATE '{AS_OF}' AS assigned_date
  FROM student_enrollments se
  JOIN classes c ON se.class_id = c.class_id
  JOIN fee_structures fs ON fs.class_level = c.class_level AND fs.academic_year_id = (SELECT max(academic_year_id) FROM academic_years WHERE is_active)
 WHERE c.academic_year_id IN (SELECT academic_year_id FROM academic_years WHERE is_active)
""")(_class_fees)


# A new structure for every level present in the active year.
def _structure_batch(s):
    lv = in_active_year(s.classes, s.academic_years).select("class_level", "academic_year_id").distinct()
    return lv.select("class_level", "academic_year_id",
                     (45000 + 31000 * F.col("class_level")).cast("decimal(10,2)").alias("total_amount"))


register("upsert_fee_structure", """
, batch AS (
  SELECT DISTINCT c.class_level, c.academic_year_id, CAST(45000 + 31000 * c.class_level AS DECIMAL(10,2)) AS amt
    FROM classes c JOIN academic_years ay ON ay.academic_year_id = c.academic_year_id WHERE ay.is_active
)
SELECT f.structure_id, f.class_level, f.academic_year_id, CAST(coalesce(b.amt, f.total_amount) AS DOUBLE)
         AS total_amount
  FROM fee_structures f
  LEFT JOIN batch b ON b.class_level = f.class_level AND b.academic_year_id = f.academic_year_id
UNION ALL
SELECT (SELECT max(structure_id) FROM fee_structures)
         + row_number() OVER (ORDER BY b.class_level, b.academic_year_id),
       b.class_level, b.academic_year_id, CAST(b.amt AS DOUBLE)
  FROM batch b
 WHERE NOT EXISTS (SELECT 1 FROM fee_structures f
                    WHERE f.class_level = b.class_level AND f.academic_year_id = b.academic_year_id)
""")(lambda s: changes.upsert_fee_structure(s, _structure_batch(s))[0])


# One day's attendance for every active-year student login.
def _attendance_batch(s):
    enr = in_active_year(s.student_enrollments, s.academic_years).where(F.col("user_id").isNotNull())
    return enr.select("enrollment_id", F.lit(ATTENDANCE_DAY).alias("attendance_date"),
                      F.when(F.col("roll_no") % 4 == 0, "Absent").otherwise("Present").alias("status"))


register("mark_attendance", f"""
, batch AS (
  SELECT se.enrollment_id, DATE '{ATTENDANCE_DAY}' AS attendance_date,
         CASE WHEN se.roll_no % 4 = 0 THEN 'Absent' ELSE 'Present' END AS status
  {_ACTIVE_ENR} AND se.user_id IS NOT NULL
)
SELECT a.* FROM attendance_students a
 WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.enrollment_id = a.enrollment_id
                                          AND b.attendance_date = a.attendance_date)
UNION ALL
SELECT (SELECT max(attendance_id) FROM attendance_students)
         + row_number() OVER (ORDER BY b.enrollment_id, b.attendance_date),
       b.enrollment_id, b.attendance_date, b.status
  FROM batch b
""")(lambda s: changes.mark_attendance(s, _attendance_batch(s))[0])


# The same batch on attendance stored by month; the result is the whole table as it is read back.
def _attendance_in_place(s):
    path = fresh_folder(s.spark, "stored")
    stored.write_partitioned(s.attendance_students, "attendance_students", path)
    stored.mark_attendance(s, path, _attendance_batch(s))
    return stored.read_partitioned(s.spark, "attendance_students", path).drop(stored.PART)


REGISTRY["mark_attendance_stored"] = (_attendance_in_place, REGISTRY["mark_attendance"][1])


# Batches with rows that must be refused: by the last digit of the roll number some have a bad
# value, a missing one, an unknown parent or a repeated key.  What is stored must survive them.
def _digit(d: int):
    return F.col("roll_no") % 10 == d


def _bad_attendance(s):
    enr = in_active_year(s.student_enrollments, s.academic_years).join(
        s.attendance_students.select("enrollment_id", "attendance_date"), "enrollment_id")
    b = enr.select("roll_no", F.when(_digit(1), F.col("enrollment_id") + 10**9).otherwise(F.col("enrollment_id")).alias("enrollment_id"),
                   "attendance_date", F.when(_digit(0), "Late").when(_digit(2), F.lit(None)).otherwise("Present").alias("status"))
    again = b.where(_digit(3)).withColumn("status", F.lit("Absent"))
    return b.unionByName(again).drop("roll_no")


_BAD_ATTENDANCE_SQL = """
, given AS (
  SELECT se.roll_no, se.enrollment_id, a.attendance_date
    FROM attendance_students a JOIN student_enrollments se USING (enrollment_id)
   WHERE se.academic_year_id IN (SELECT academic_year_id FROM academic_years WHERE is_active)
), batch AS (
  SELECT roll_no % 10 AS d, enrollment_id + CASE WHEN roll_no % 10 = 1 THEN 1000000000 ELSE 0 END AS enrollment_id, attendance_date,
         CASE roll_no % 10 WHEN 0 THEN 'Late' WHEN 2 THEN NULL ELSE 'Present' END AS status FROM given
  UNION ALL SELECT 3, enrollment_id, attendance_date, 'Absent' FROM given WHERE roll_no % 10 = 3
), judged AS (
  SELECT *, CASE d WHEN 0 THEN 'bad_value:status' WHEN 1 THEN 'missing_parent:enrollment_id' WHEN 2 THEN 'missing:status'
                   WHEN 3 THEN CASE WHEN status = 'Present' THEN 'duplicate_in_batch:enrollment_id,attendance_date' END END AS reason
    FROM batch
)
"""

register("mark_attendance_rejected", _BAD_ATTENDANCE_SQL + """
SELECT enrollment_id, attendance_date, status, reason FROM judged WHERE reason IS NOT NULL
""")(lambda s: changes.mark_attendance(s, _bad_attendance(s), ["status"])[1].select("enrollment_id", "attendance_date", "status", "reason"))

register("mark_attendance_with_bad_rows", _BAD_ATTENDANCE_SQL + """
SELECT enrollment_id, attendance_date, status FROM judged WHERE reason IS NULL
UNION ALL
SELECT a.enrollment_id, a.attendance_date, a.status FROM attendance_students a
 WHERE (a.enrollment_id, a.attendance_date) NOT IN (SELECT (enrollment_id, attendance_date) FROM judged WHERE reason IS NULL)
""")(lambda s: changes.mark_attendance(s, _bad_attendance(s), ["status"])[0].drop("attendance_id"))


def _bad_fees(s):
    enr = in_active_year(s.student_enrollments, s.academic_years)
    return enr.select(F.when(_digit(1), F.col("enrollment_id") + 10**9).otherwise(F.col("enrollment_id")).alias("enrollment_id"),
                      F.when(~_digit(0), F.lit(70000)).cast("decimal(10,2)").alias("total_amount"),
                      F.when(~_digit(2), F.lit(AS_OF)).cast("date").alias("assigned_date"))


_BAD_FEES_SQL = f"""
, judged AS (
  SELECT enrollment_id + CASE WHEN roll_no % 10 = 1 THEN 1000000000 ELSE 0 END AS enrollment_id,
         CAST(CASE WHEN roll_no % 10 <> 0 THEN 70000 END AS DOUBLE) AS total_amount,
         CASE WHEN roll_no % 10 <> 2 THEN DATE '{AS_OF}' END AS assigned_date,
         CASE roll_no % 10 WHEN 0 THEN 'missing:total_amount' WHEN 1 THEN 'missing_parent:enrollment_id' WHEN 2 THEN 'missing:assigned_date' END AS reason
    FROM student_enrollments WHERE academic_year_id IN (SELECT academic_year_id FROM academic_years WHERE is_active)
)
"""

register("assign_fees_rejected", _BAD_FEES_SQL + """
SELECT enrollment_id, total_amount, assigned_date, reason FROM judged WHERE reason IS NOT NULL
""")(lambda s: changes.assign_fees(s, _bad_fees(s), "upsert")[1])

register("assign_fees_with_bad_rows", _BAD_FEES_SQL + """
SELECT a.enrollment_id, coalesce(j.total_amount, a.total_amount) AS total_amount, coalesce(j.assigned_date, a.assigned_date) AS assigned_date
  FROM student_fee_assignments a LEFT JOIN (SELECT * FROM judged WHERE reason IS NULL) j USING (enrollment_id)
UNION ALL
SELECT enrollment_id, total_amount, assigned_date FROM judged
 WHERE reason IS NULL AND enrollment_id NOT IN (SELECT enrollment_id FROM student_fee_assignments)
""")(lambda s: changes.assign_fees(s, _bad_fees(s), "upsert")[0].drop("assignment_id"))


def _bad_structures(s):
    y = s.classes.select("class_level", "academic_year_id").distinct()
    lv = F.col("class_level")
    return y.select(F.when(lv == 9, 11).otherwise(lv).alias("class_level"),
                    F.when(lv == 8, F.col("academic_year_id") + 10**6).otherwise(F.col("academic_year_id")).alias("academic_year_id"),
                    F.when(lv != 7, 1000 * lv).cast("decimal(10,2)").alias("total_amount"))


register("upsert_fee_structure_rejected", """
SELECT DISTINCT CASE WHEN class_level = 9 THEN 11 ELSE class_level END AS class_level,
       academic_year_id + CASE WHEN class_level = 8 THEN 1000000 ELSE 0 END AS academic_year_id,
       CAST(CASE WHEN class_level <> 7 THEN 1000 * class_level END AS DOUBLE) AS total_amount,
       CASE class_level WHEN 7 THEN 'missing:total_amount' WHEN 8 THEN 'missing_parent:academic_year_id' ELSE 'bad_value:class_level' END AS reason
  FROM classes WHERE class_level IN (7, 8, 9)
""")(lambda s: changes.upsert_fee_structure(s, _bad_structures(s))[1])


# W2 with checks: a new class, roll number and status for the active year's enrollments.
def _enrollment_changes(s):
    enr = in_active_year(s.student_enrollments, s.academic_years)
    lowest = enr.groupBy("class_id").agg(F.min("roll_no").alias("lowest"))
    b = enr.join(lowest, "class_id").select(
        F.when(_digit(4), F.col("enrollment_id") + 10**9).otherwise(F.col("enrollment_id")).alias("enrollment_id"),
        F.when(_digit(1), F.lit(999999)).otherwise(F.col("class_id")).cast("long").alias("class_id"),
        F.when(_digit(3), F.col("lowest")).otherwise(F.col("roll_no") + 2000000).alias("new_roll"),
        F.when(_digit(0), "gone").otherwise("left").alias("status"), "roll_no")
    again = b.where(_digit(2)).withColumn("status", F.lit("passed"))
    return b.unionByName(again).select("enrollment_id", "class_id", F.col("new_roll").alias("roll_no"), "status")


_ENROLLMENT_CHANGES_SQL = """
, active AS (SELECT *, min(roll_no) OVER (PARTITION BY class_id) AS lowest FROM student_enrollments
              WHERE academic_year_id IN (SELECT academic_year_id FROM academic_years WHERE is_active)),
batch AS (
  SELECT roll_no AS old, lowest, enrollment_id + CASE WHEN roll_no % 10 = 4 THEN 1000000000 ELSE 0 END AS enrollment_id,
         CASE WHEN roll_no % 10 = 1 THEN 999999 ELSE class_id END AS class_id,
         CAST(CASE WHEN roll_no % 10 = 3 THEN lowest ELSE roll_no + 2000000 END AS INTEGER) AS roll_no,
         CASE WHEN roll_no % 10 = 0 THEN 'gone' ELSE 'left' END AS status
    FROM active
), judged AS (
  SELECT *, CASE old % 10 WHEN 0 THEN 'bad_value:status' WHEN 1 THEN 'missing_parent:class_id' WHEN 4 THEN 'no_row'
                 WHEN 3 THEN CASE WHEN old = min(CASE WHEN old % 10 = 3 THEN old END) OVER (PARTITION BY class_id) THEN
                               CASE WHEN old <> lowest THEN 'duplicate_key:class_id,roll_no' END
                             ELSE 'taken' END END AS reason FROM batch
  UNION ALL SELECT old, lowest, enrollment_id, class_id, roll_no, 'passed', 'duplicate_in_batch:enrollment_id' FROM batch WHERE old % 10 = 2
)
"""

register("update_enrollments_rejected", _ENROLLMENT_CHANGES_SQL + """
SELECT enrollment_id, class_id, roll_no, status, CASE WHEN reason = 'taken' OR reason LIKE 'duplicate%roll_no' THEN 'roll taken' ELSE reason END AS reason
  FROM judged WHERE reason IS NOT NULL
""")(lambda s: changes.update_table(s, "student_enrollments", _enrollment_changes(s))[1]
     .withColumn("reason", F.when(F.col("reason").rlike("^duplicate.*roll_no$"), "roll taken").otherwise(F.col("reason"))))

register("update_enrollments", _ENROLLMENT_CHANGES_SQL + """
SELECT se.enrollment_id, se.student_master_id, se.academic_year_id, se.class_id, coalesce(j.roll_no, se.roll_no) AS roll_no,
       se.admission_date, se.user_id, coalesce(j.status, se.status) AS status
  FROM student_enrollments se LEFT JOIN (SELECT * FROM judged WHERE reason IS NULL) j USING (enrollment_id)
""")(lambda s: changes.update_table(s, "student_enrollments", _enrollment_changes(s))[0])


# W1 for years and classes, with rows that must be refused.
def _bad_years(s):
    y = s.academic_years
    fresh = y.agg(F.max("start_date").alias("start_date"), F.max("end_date").alias("end_date")).select(
        F.lit("2099-00").alias("year_name"), F.add_months("start_date", 12).alias("start_date"), F.add_months("end_date", 12).alias("end_date"))
    long = y.select(F.concat("year_name", F.lit("-long")).alias("year_name"), "start_date", "end_date")
    return y.select("year_name", "start_date", "end_date").unionByName(long).unionByName(fresh)


register("append_years_rejected", """
SELECT year_name, 'duplicate_key:year_name' AS reason FROM academic_years
UNION ALL SELECT year_name || '-long', 'too_long:year_name' FROM academic_years
""")(lambda s: changes.append_rows(s, "academic_years", _bad_years(s), ["start_date"])[1].select("year_name", "reason"))

register("append_years", """
SELECT max(academic_year_id) + 1 AS academic_year_id, '2099-00' AS year_name, CAST(max(start_date) + INTERVAL 12 MONTH AS DATE) AS start_date,
       CAST(max(end_date) + INTERVAL 12 MONTH AS DATE) AS end_date, false AS is_active, false AS is_closed
  FROM academic_years
""")(lambda s: changes.append_rows(s, "academic_years", _bad_years(s), ["start_date"])[0].drop("created_at"))


def _bad_classes(s):
    kind = F.col("class_id") % 4
    return s.classes.select(
        F.when(kind == 3, 12).otherwise(F.col("class_level")).alias("class_level"),
        F.when(kind == 1, "Z").otherwise(F.col("division")).alias("division"),
        F.when(kind == 2, F.col("academic_year_id") + 10**6).otherwise(F.col("academic_year_id")).alias("academic_year_id"), "class_teacher_id")


register("append_classes_rejected", """
SELECT CAST(CASE WHEN class_id % 4 = 3 THEN 12 ELSE class_level END AS INTEGER) AS class_level, CASE WHEN class_id % 4 = 1 THEN 'Z' ELSE division END AS division,
       academic_year_id + CASE WHEN class_id % 4 = 2 THEN 1000000 ELSE 0 END AS academic_year_id,
       CASE class_id % 4 WHEN 0 THEN 'duplicate_key:class_level,division,academic_year_id' WHEN 1 THEN 'bad_value:division'
            WHEN 2 THEN 'missing_parent:academic_year_id' ELSE 'bad_value:class_level' END AS reason
  FROM classes
""")(lambda s: changes.append_rows(s, "classes", _bad_classes(s), ["class_level", "division"])[1].select(
    "class_level", "division", "academic_year_id", "reason"))


# R1, R8 and R15 from totals after three batches: new payments (W1), new fees of the active year (W5),
# and the students who have left are deleted with all that is theirs.
def _changed(s):
    """(school after the batches, its totals, folded and never counted again)."""
    kept = totals.count_totals(s)
    path = fresh_folder(s.spark, "totals")
    totals.write_totals(kept, path)
    kept = totals.read_totals(s.spark, path)
    paid = _append_payments(s)[0]
    kept = totals.fold(kept, totals.payments_stored(paid))
    s = s.replace(fee_payments=s.fee_payments.unionByName(paid))
    batch = _fee_batch(s)
    table, _ = changes.assign_fees(s, batch, "upsert")
    kept = totals.fold(kept, totals.fees_assigned(s, table, batch))
    s = s.replace(student_fee_assignments=table)
    left = s.student_enrollments.where("status = 'left'").select("student_master_id").distinct()
    gone = s.student_enrollments.join(by_key(left), "student_master_id", "left_semi")
    kept = totals.fold(kept, totals.enrollments_deleted(s, gone))
    return lifecycle.delete_cascade(s, "student_master", left), kept


_CHANGED_SQL = _PAYMENT_BATCH_SQL + f"""
, staying AS (SELECT * FROM student_enrollments
               WHERE student_master_id NOT IN (SELECT student_master_id FROM student_enrollments WHERE status = 'left'))
, payments AS (
  SELECT enrollment_id, payment_date, amount_paid FROM fee_payments SEMI JOIN staying USING (enrollment_id)
  UNION ALL
  SELECT enrollment_id, payment_date, amount_paid FROM checked SEMI JOIN staying USING (enrollment_id) WHERE reason IS NULL
)
, new_fees AS (
  SELECT enrollment_id, CAST(50000 + 1000 * class_level AS DECIMAL(10,2)) AS fee
    FROM staying JOIN classes USING (class_id) JOIN academic_years ON academic_years.academic_year_id = staying.academic_year_id WHERE is_active
)
, assignments AS (
  SELECT enrollment_id, coalesce(fee, total_amount) AS total_amount
    FROM student_fee_assignments SEMI JOIN staying USING (enrollment_id) LEFT JOIN new_fees USING (enrollment_id)
  UNION ALL
  SELECT enrollment_id, fee FROM new_fees WHERE enrollment_id NOT IN (SELECT enrollment_id FROM student_fee_assignments)
)
, paid AS (SELECT enrollment_id, sum(amount_paid) AS paid, count(*) AS n_payments FROM payments GROUP BY enrollment_id)
, fees AS (SELECT enrollment_id, sum(total_amount) AS fee, count(*) AS n_assign FROM assignments GROUP BY enrollment_id)
"""

register("fee_status_from_totals", _CHANGED_SQL + """
, lines AS (SELECT enrollment_id, total_amount, count(*) AS n_copies FROM assignments GROUP BY enrollment_id, total_amount)
SELECT enrollment_id, student_master_id, reg_no, concat(fname, ' ', lname) AS student_name, roll_no, class_level, division, mobile, year_name,
       CAST(coalesce(total_amount, 0) AS DOUBLE) AS total_amount, CAST(coalesce(paid * coalesce(n_copies, 1), 0) AS DOUBLE) AS total_paid,
       CAST(coalesce(total_amount, 0) - coalesce(paid * coalesce(n_copies, 1), 0) AS DOUBLE) AS total_pending
  FROM staying LEFT JOIN lines USING (enrollment_id) LEFT JOIN paid USING (enrollment_id)
  JOIN student_master USING (student_master_id) JOIN classes USING (class_id)
  JOIN academic_years ON academic_years.academic_year_id = staying.academic_year_id WHERE is_active
""")(lambda s: fees.fee_status(*_changed(s)))

register("fee_summary_from_totals", _CHANGED_SQL + """
SELECT academic_year_id, CAST(sum(fee) AS DOUBLE) AS total_fees, CAST(coalesce(sum(paid), 0) AS DOUBLE) AS collected,
       CAST(sum(fee) - coalesce(sum(paid), 0) AS DOUBLE) AS pending
  FROM fees JOIN staying USING (enrollment_id) LEFT JOIN paid USING (enrollment_id) GROUP BY academic_year_id
""")(lambda s: (lambda now, kept: fees.fee_summary(now, totals=kept))(*_changed(s)))

register("fee_summary_as_written_from_totals", _CHANGED_SQL + """
SELECT academic_year_id, CAST(sum(a.total_amount) AS DOUBLE) AS total_fees, CAST(sum(p.amount_paid) AS DOUBLE) AS collected,
       CAST(sum(a.total_amount) - sum(p.amount_paid) AS DOUBLE) AS pending
  FROM staying JOIN assignments a USING (enrollment_id) LEFT JOIN payments p USING (enrollment_id) GROUP BY academic_year_id
""")(lambda s: (lambda now, kept: fees.fee_summary_as_written(now, totals=kept))(*_changed(s)))

register("accountant_dashboard_from_totals", _CHANGED_SQL + f"""
, due AS (SELECT sum(fee - coalesce(paid, 0) * n_assign) AS total_pending
            FROM fees JOIN staying USING (enrollment_id) JOIN academic_years USING (academic_year_id) LEFT JOIN paid USING (enrollment_id) WHERE is_active)
SELECT (SELECT count(*) FROM staying JOIN academic_years USING (academic_year_id) WHERE is_active) AS total_students,
       CAST(coalesce((SELECT sum(amount_paid) FROM payments WHERE date_trunc('month', payment_date) = DATE '{AS_OF:%Y-%m}-01'), 0) AS DOUBLE) AS monthly_collection,
       CAST(coalesce((SELECT sum(amount_paid) FROM payments), 0) AS DOUBLE) AS total_collected,
       CAST(coalesce(total_pending, 0) AS DOUBLE) AS total_pending FROM due
""")(lambda s: (lambda now, kept: fees.accountant_dashboard(now, AS_OF, totals=kept))(*_changed(s)))

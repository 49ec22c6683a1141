"""Registered runs of acceptance in order, generated values, closed years, collated keys and
searches for many keywords, with DuckDB oracles.

The oracles of acceptance take the rows one after another, class by class, in a recursive query.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rollbook.catalog import AS_OF, register
from rollbook.operators import audit, changes, lifecycle, people
from rollbook.plans.dims import by_key, in_active_year

ADMISSION = dt.date(2000, 2, 1)
COLLATION = "UNICODE_CI_AI"


# W1 over two unique keys: the active year is enrolled anew, and every student asks for three
# places; some first choices name no class and some second ones no valid status.  A place that a
# refused choice names stays free for the next student.
def _choices(s):
    old = in_active_year(s.student_enrollments, s.academic_years)
    seat, roll = F.floor(F.col("roll_no") / 30), F.col("roll_no")
    one = lambda n, cls, place, status: F.struct(F.lit(n).alias("choice"), cls.alias("class_id"), place.cast("int").alias("roll_no"), status.alias("status"))
    active = F.lit("active")
    wishes = F.array(
        one(1, F.when(roll % 4 == 0, -F.col("class_id")).otherwise(F.col("class_id")), seat % 16, active),
        one(2, F.col("class_id"), seat % 23, F.when(roll % 5 == 0, F.lit("gone")).otherwise(active)),
        one(3, F.col("class_id"), 100000 + roll, active))
    batch = old.select(F.col("enrollment_id").alias("turn"), "student_master_id", "academic_year_id", F.lit(ADMISSION).alias("admission_date"), F.inline(wishes))
    others = s.student_enrollments.join(s.academic_years.where("is_active <=> true"), "academic_year_id", "left_anti")
    return changes.append_rows(s.replace(student_enrollments=others.select(*s.student_enrollments.columns)), "student_enrollments", batch, ["turn", "choice"])


_CHOICES_SQL = f"""
SELECT * FROM (
WITH RECURSIVE old AS (
  SELECT se.* FROM student_enrollments se JOIN academic_years ay ON ay.academic_year_id = se.academic_year_id WHERE ay.is_active
), base AS (
  SELECT max(se.enrollment_id) AS last FROM student_enrollments se JOIN academic_years ay ON ay.academic_year_id = se.academic_year_id WHERE NOT ay.is_active
), batch AS (
  SELECT enrollment_id AS turn, 1 AS choice, student_master_id, academic_year_id, class_id AS home,
         CASE WHEN roll_no % 4 = 0 THEN -class_id ELSE class_id END AS class_id, CAST((roll_no // 30) % 16 AS INTEGER) AS roll_no, 'active' AS status FROM old
  UNION ALL SELECT enrollment_id, 2, student_master_id, academic_year_id, class_id, class_id, CAST((roll_no // 30) % 23 AS INTEGER),
         CASE WHEN roll_no % 5 = 0 THEN 'gone' ELSE 'active' END FROM old
  UNION ALL SELECT enrollment_id, 3, student_master_id, academic_year_id, class_id, class_id, CAST(100000 + roll_no AS INTEGER), 'active' FROM old
), able AS (
  SELECT *, row_number() OVER (PARTITION BY home ORDER BY turn, choice) AS n FROM batch WHERE class_id > 0 AND status = 'active'
), taken AS (
  SELECT home, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS students, CAST([] AS INTEGER[]) AS rolls, false AS stored FROM (SELECT DISTINCT home FROM able)
  UNION ALL
  SELECT home, n, CASE WHEN free THEN list_append(students, student_master_id) ELSE students END,
         CASE WHEN free THEN list_append(rolls, roll_no) ELSE rolls END, free
    FROM (SELECT a.*, t.students, t.rolls, NOT list_contains(t.students, a.student_master_id) AND NOT list_contains(t.rolls, a.roll_no) AS free
            FROM taken t JOIN able a ON a.home = t.home AND a.n = t.n + 1)
), stored AS (
  SELECT a.* FROM able a JOIN taken t ON t.home = a.home AND t.n = a.n WHERE t.stored
), judged AS (
  SELECT b.*, EXISTS (SELECT 1 FROM stored x WHERE x.turn = b.turn AND x.choice = b.choice) AS is_stored,
         EXISTS (SELECT 1 FROM stored x WHERE x.student_master_id = b.student_master_id AND (x.turn, x.choice) < (b.turn, b.choice)) AS has_place,
         EXISTS (SELECT 1 FROM stored x WHERE x.class_id = b.class_id AND x.roll_no = b.roll_no AND (x.turn, x.choice) < (b.turn, b.choice)) AS place_gone
    FROM batch b
)
"""

register("append_enrollments_in_order", _CHOICES_SQL + f"""
SELECT base.last + row_number() OVER (ORDER BY turn, choice) AS enrollment_id, student_master_id, academic_year_id, class_id, roll_no,
       DATE '{ADMISSION}' AS admission_date
  FROM judged, base WHERE is_stored)
""")(lambda s: _choices(s)[0].select("enrollment_id", "student_master_id", "academic_year_id", "class_id", "roll_no", "admission_date"))

register("append_enrollments_in_order_rejected", _CHOICES_SQL + """
SELECT turn, choice, CASE WHEN status = 'gone' THEN 'bad_value:status' WHEN has_place THEN 'duplicate_in_batch:student_master_id,academic_year_id'
       WHEN place_gone THEN 'duplicate_in_batch:class_id,roll_no' ELSE 'missing_parent:class_id' END AS reason
  FROM judged WHERE NOT is_stored)
""")(lambda s: _choices(s)[1].select("turn", "choice", "reason"))


# W1 with some receipts given and the others generated: given ones are numbers that new ids reach.
def _mixed_receipts(s):
    enr = in_active_year(s.student_enrollments, s.academic_years)
    last = s.fee_payments.agg(F.max("payment_id")).scalar()
    given = F.concat(F.lit("RCP"), (last + 1 + F.col("enrollment_id") % 1000).cast("string"))
    batch = enr.select("enrollment_id", F.lit(700).cast("decimal(10,2)").alias("amount_paid"), F.lit(AS_OF).alias("payment_date"),
                       F.when(F.col("roll_no") % 3 == 0, given).alias("receipt_no"))
    return changes.append_rows(s, "fee_payments", batch, ["enrollment_id"], generate={"receipt_no": "RCP"})


register("append_payments_mixed_receipts", """
, last AS (SELECT max(payment_id) AS id FROM fee_payments),
batch AS (
  SELECT se.enrollment_id, CASE WHEN se.roll_no % 3 = 0 THEN 'RCP' || CAST(last.id + 1 + se.enrollment_id % 1000 AS VARCHAR) END AS given
    FROM student_enrollments se JOIN academic_years ay ON ay.academic_year_id = se.academic_year_id, last WHERE ay.is_active
), ok AS (
  SELECT enrollment_id, given, (SELECT id FROM last) + row_number() OVER (ORDER BY enrollment_id) AS payment_id
    FROM (SELECT *, row_number() OVER (PARTITION BY given ORDER BY enrollment_id) AS n FROM batch)
   WHERE given IS NULL OR (n = 1 AND given NOT IN (SELECT receipt_no FROM fee_payments))
), taken AS (
  SELECT receipt_no FROM fee_payments UNION SELECT given FROM ok WHERE given IS NOT NULL
), numbers AS (
  SELECT greatest((SELECT max(payment_id) FROM ok), (SELECT id FROM last),
                  (SELECT max(TRY_CAST(substr(receipt_no, 4) AS BIGINT)) FROM taken)) AS last
), made AS (
  SELECT *, 'RCP' || CAST(payment_id AS VARCHAR) IN (SELECT receipt_no FROM taken) AS moved FROM ok WHERE given IS NULL
)
SELECT payment_id, enrollment_id, given AS receipt_no FROM ok WHERE given IS NOT NULL
UNION ALL
SELECT payment_id, enrollment_id, 'RCP' || CAST(payment_id AS VARCHAR) FROM made WHERE NOT moved
UNION ALL
SELECT payment_id, enrollment_id, 'RCP' || CAST(numbers.last + row_number() OVER (ORDER BY payment_id) AS VARCHAR) FROM made, numbers WHERE moved
""")(lambda s: _mixed_receipts(s)[0].select("payment_id", "enrollment_id", "receipt_no"))


# Every enrollment's student admitted once more to its class, with closed years closed.
def _admit_everywhere(s):
    batch = s.student_enrollments.join(by_key(s.student_master.select("student_master_id", "fname", "gender")), "student_master_id").select(
        F.concat(F.lit("C"), F.col("enrollment_id").cast("string")).alias("reg_no"), "fname",
        F.when(F.col("roll_no") % 11 != 0, F.col("gender")).alias("gender"), (3000000 + F.col("roll_no")).cast("int").alias("roll_no"),
        "class_id", "academic_year_id", F.lit(ADMISSION).alias("admission_date"))
    return lifecycle.admit_students(s, batch, ["reg_no"], enforce_closed=True)


_ADMIT_SQL = """
, batch AS (
  SELECT 'C' || CAST(se.enrollment_id AS VARCHAR) AS reg_no, se.class_id, se.academic_year_id,
         CASE WHEN se.roll_no % 11 = 0 OR sm.gender IS NULL THEN 'missing:gender' WHEN ay.is_closed THEN 'closed_year' END AS reason
    FROM student_enrollments se JOIN student_master sm ON sm.student_master_id = se.student_master_id
    JOIN academic_years ay ON ay.academic_year_id = se.academic_year_id
)
"""

register("admit_students_closed", _ADMIT_SQL + """
SELECT (SELECT max(student_master_id) FROM student_master) + row_number() OVER (ORDER BY reg_no) AS student_master_id, reg_no, class_id, academic_year_id
  FROM batch WHERE reason IS NULL
""")(lambda s: _admit_everywhere(s)[1].select("student_master_id", "reg_no", "class_id", "academic_year_id"))

register("admit_students_closed_rejected", _ADMIT_SQL + """
SELECT reg_no, reason FROM batch WHERE reason IS NOT NULL
""")(lambda s: _admit_everywhere(s)[2].select("reg_no", "reason"))


# Every enrollment is to leave, and every class to pass without a next one.
def _all_leave(s):
    return changes.update_table(s, "student_enrollments", s.student_enrollments.select("enrollment_id", F.lit("left").alias("status")), enforce_closed=True)


register("update_enrollments_closed", """
SELECT se.enrollment_id, CASE WHEN ay.is_closed THEN se.status ELSE 'left' END AS status
  FROM student_enrollments se JOIN academic_years ay ON ay.academic_year_id = se.academic_year_id
""")(lambda s: _all_leave(s)[0].select("enrollment_id", "status"))

register("update_enrollments_closed_rejected", """
SELECT se.enrollment_id, 'closed_year' AS reason
  FROM student_enrollments se JOIN academic_years ay ON ay.academic_year_id = se.academic_year_id WHERE ay.is_closed
""")(lambda s: _all_leave(s)[1].select("enrollment_id", "reason"))

register("promote_closed_refused", """
SELECT c.academic_year_id AS from_year, c.class_id AS from_class, 'closed_year' AS reason
  FROM classes c JOIN academic_years ay ON ay.academic_year_id = c.academic_year_id WHERE ay.is_closed
UNION ALL
SELECT c.academic_year_id, c.class_id, 'no_students' FROM classes c JOIN academic_years ay ON ay.academic_year_id = c.academic_year_id
 WHERE NOT ay.is_closed AND NOT EXISTS (SELECT 1 FROM student_enrollments se
       WHERE se.class_id = c.class_id AND se.academic_year_id = c.academic_year_id AND se.status = 'active')
""")(lambda s: lifecycle.promote(s, s.classes.select(
    F.col("academic_year_id").alias("from_year"), F.col("class_id").alias("from_class"),
    (F.lit(1) + s.academic_years.agg(F.max("academic_year_id")).scalar()).alias("to_year"), F.lit(None).cast("long").alias("to_class")),
    enforce_closed=True)[1].select("from_year", "from_class", "reason"))


# User names that differ in case or accents only are one name.  Every employee's name comes back in
# lower case, and three spellings of a new one are asked for.
def _name_batch(s):
    eid = F.col("employee_id").cast("string")
    spelt = F.array(F.lower("reg_no"), F.concat(F.lit("José"), eid), F.concat(F.lit("JOSE"), eid), F.concat(F.lit("jósé"), eid))
    return s.employees.select(F.posexplode(spelt).alias("spelling", "username"), "employee_id", F.lit("teacher").alias("role"))


def _append_names(s):
    return changes.append_rows(s, "users", _name_batch(s), ["employee_id", "spelling"], collation=COLLATION)


_NAMES_SQL = """
, batch AS (
  SELECT employee_id, CAST(0 AS INTEGER) AS spelling, lower(reg_no) AS username FROM employees
  UNION ALL SELECT employee_id, 1, 'José' || CAST(employee_id AS VARCHAR) FROM employees
  UNION ALL SELECT employee_id, 2, 'JOSE' || CAST(employee_id AS VARCHAR) FROM employees
  UNION ALL SELECT employee_id, 3, 'jósé' || CAST(employee_id AS VARCHAR) FROM employees
), folded AS (
  SELECT *, lower(strip_accents(username)) AS name,
         row_number() OVER (PARTITION BY lower(strip_accents(username)) ORDER BY employee_id, spelling) AS n FROM batch
), judged AS (
  SELECT *, CASE WHEN n > 1 THEN 'duplicate_in_batch:username'
                 WHEN name IN (SELECT lower(strip_accents(username)) FROM users) THEN 'duplicate_key:username' END AS reason FROM folded
)
"""

register("append_users_collated", _NAMES_SQL + """
SELECT (SELECT max(user_id) FROM users) + row_number() OVER (ORDER BY employee_id, spelling) AS user_id, username, 'teacher' AS role
  FROM judged WHERE reason IS NULL
""")(lambda s: _append_names(s)[0].select("user_id", "username", "role"))

register("append_users_collated_rejected", _NAMES_SQL + """
SELECT employee_id, username, reason FROM judged WHERE reason IS NOT NULL
""")(lambda s: _append_names(s)[1].select("employee_id", "username", "reason"))

register("users_exist_collated", """
, wanted AS (
  SELECT DISTINCT lower(reg_no) AS username FROM student_master
  UNION SELECT 'ÁDMIN' UNION SELECT 'nobody'
)
SELECT w.username, (SELECT count(*) FROM users u WHERE lower(strip_accents(u.username)) = lower(strip_accents(w.username))) AS count FROM wanted w
""")(lambda s: people.users_exist(s, s.student_master.select(F.lower("reg_no").alias("username")).unionByName(
    s.academic_years.select(F.explode(F.array(F.lit("ÁDMIN"), F.lit("nobody"))).alias("username"))), COLLATION))

# Q1 on the stored names and the batch together.
register("audit_unique_collated", _NAMES_SQL + """
, whole AS (SELECT username FROM users UNION ALL SELECT username FROM batch)
SELECT min(username) AS username, count(*) AS n FROM whole GROUP BY lower(strip_accents(username)) HAVING count(*) > 1
""")(lambda s: audit.audit_unique(s.users.select("username").unionByName(_name_batch(s).select("username")), ["username"], COLLATION))


# R48 for a table of keywords: what the numbers of employees end in, whole numbers and single letters.
def _user_keywords(s):
    reg_no = F.col("reg_no")
    return s.employees.select(F.explode(F.array(F.lower(reg_no), F.substring(reg_no, -2, 2), F.substring(reg_no, -3, 3), F.concat(reg_no, F.lit("_%")))).alias("keyword")).distinct()


register("search_users_keywords", """
, wanted AS (
  SELECT DISTINCT unnest([lower(reg_no), right(reg_no, 2), right(reg_no, 3), reg_no || '_%']) AS keyword FROM employees
)
SELECT keyword, user_id, username FROM users JOIN wanted ON contains(lower(username), lower(keyword))
""")(lambda s: people.search_keywords(s.users.select("user_id", "username"), "username", _user_keywords(s)))

register("search_subjects_keywords", """
, wanted AS (
  SELECT DISTINCT unnest([upper(subject_name), left(subject_name, 1), right(subject_name, 2), substr(subject_name, 2, 3), subject_name || '?', '']) AS keyword FROM subjects
)
SELECT keyword, subject_id, subject_name FROM subjects JOIN wanted ON contains(lower(subject_name), lower(keyword))
""")(lambda s: people.search_keywords(s.subjects.select("subject_id", "subject_name"), "subject_name", s.subjects.select(F.explode(F.array(
    F.upper("subject_name"), F.substring("subject_name", 1, 1), F.substring("subject_name", -2, 2), F.substring("subject_name", 2, 3),
    F.concat("subject_name", F.lit("?")), F.lit(""))).alias("keyword"))))

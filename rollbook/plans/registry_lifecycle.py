"""Registered multi-table changes (W9–W13) with DuckDB oracles."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.catalog import register
from rollbook.operators import lifecycle, stored
from rollbook.operators.changes import append, append_rows
from rollbook.plans.dims import cut_lineage, fresh_folder, in_active_year
from rollbook.sources.schema import SCHEMAS

ADMIT_DAY = dt.date(2001, 6, 1)
HIRE_DAY = dt.date(2001, 1, 1)

_GRADE_SQL = """CASE WHEN max_marks IS NULL OR max_marks <= 0 THEN NULL
            WHEN coalesce(marks_obtained, 0) * 100 >= max_marks * 90 THEN 'A+'
            WHEN coalesce(marks_obtained, 0) * 100 >= max_marks * 80 THEN 'A'
            WHEN coalesce(marks_obtained, 0) * 100 >= max_marks * 70 THEN 'B'
            WHEN coalesce(marks_obtained, 0) * 100 >= max_marks * 60 THEN 'C'
            WHEN coalesce(marks_obtained, 0) * 100 >= max_marks * 40 THEN 'D'
            ELSE 'F' END"""


# A mark in every subject for every active student of the active year; odd subjects
# go to a new exam ('Retest') that has to be created.
def marks_batch(s) -> DataFrame:
    enr = (in_active_year(s.student_enrollments, s.academic_years).where(F.col("status") == "active")
           .select("enrollment_id", "class_id", "roll_no"))
    sub = s.subjects.select("subject_id", "class_id")
    r, sid = F.col("roll_no"), F.col("subject_id")
    return enr.join(sub, "class_id").select(
        "subject_id", F.when(sid % 2 == 0, "Final").otherwise("Retest").alias("exam_name"),
        F.lit(100).alias("max_marks"), "enrollment_id",
        F.when(r % 23 == 0, F.lit(None)).otherwise((r * 7 + sid) % 101).alias("marks_obtained"))


_MARKS_SQL = """
, batch AS (
  SELECT sub.subject_id, CASE WHEN sub.subject_id % 2 = 0 THEN 'Final' ELSE 'Retest' END AS exam_name,
         CAST(100 AS DECIMAL(5,2)) AS max_marks, se.enrollment_id,
         CAST(CASE WHEN se.roll_no % 23 = 0 THEN NULL ELSE (se.roll_no * 7 + sub.subject_id) % 101 END
              AS DECIMAL(5,2)) AS marks_obtained, sub.academic_year_id
    FROM student_enrollments se JOIN academic_years ay ON ay.academic_year_id = se.academic_year_id
    JOIN subjects sub ON sub.class_id = se.class_id
   WHERE ay.is_active AND se.status = 'active'
), new_exams AS (
  SELECT (SELECT max(exam_id) FROM exams) + row_number() OVER (ORDER BY academic_year_id, exam_name) AS exam_id,
         exam_name, academic_year_id
    FROM (SELECT DISTINCT exam_name, academic_year_id FROM batch b
           WHERE NOT EXISTS (SELECT 1 FROM exams e
                              WHERE e.exam_name = b.exam_name AND e.academic_year_id = b.academic_year_id))
), all_exams AS (
  SELECT exam_id, exam_name, academic_year_id FROM exams UNION ALL SELECT * FROM new_exams
), rows AS (
  SELECT b.enrollment_id, b.subject_id, x.exam_id, b.marks_obtained, b.max_marks
    FROM batch b JOIN all_exams x ON x.exam_name = b.exam_name AND x.academic_year_id = b.academic_year_id
)
"""

register("add_marks", _MARKS_SQL + f"""
SELECT (SELECT max(mark_id) FROM marks) + row_number() OVER (ORDER BY enrollment_id, subject_id, exam_id)
         AS mark_id,
       enrollment_id, subject_id, exam_id, CAST(marks_obtained AS DOUBLE) AS marks_obtained,
       CAST(max_marks AS DOUBLE) AS max_marks, {_GRADE_SQL} AS grade
  FROM rows
""")(lambda s: lifecycle.add_marks(s, marks_batch(s))[1])


# W9 on marks stored by exam: the same batch; the result is the whole table as it is read back.
def _marks_in_place(s) -> DataFrame:
    path = fresh_folder(s.spark, "stored")
    stored.write_partitioned(s.marks, "marks", path)
    return stored.add_marks(s, path, marks_batch(s))[0].marks


register("add_marks_stored", _MARKS_SQL + f"""
SELECT mark_id, enrollment_id, subject_id, exam_id, CAST(marks_obtained AS DOUBLE) AS marks_obtained, CAST(max_marks AS DOUBLE) AS max_marks, grade
  FROM marks ANTI JOIN rows USING (enrollment_id, subject_id, exam_id)
UNION ALL
SELECT (SELECT max(mark_id) FROM marks) + row_number() OVER (ORDER BY enrollment_id, subject_id, exam_id), enrollment_id, subject_id, exam_id,
       CAST(marks_obtained AS DOUBLE), CAST(max_marks AS DOUBLE), {_GRADE_SQL}
  FROM rows
""")(_marks_in_place)


# Marks of which some must be refused, by the last digit of the roll number: an exam name that is
# too long, a number that does not fit, an unknown subject or enrollment, a repeated triple.
def bad_marks_batch(s) -> DataFrame:
    d = (F.col("enrollment_id") % 10)
    b = marks_batch(s).select(
        F.when(d == 2, F.col("subject_id") + 10**6).otherwise(F.col("subject_id")).alias("subject_id"),
        F.when(d == 0, F.repeat(F.lit("x"), 60)).otherwise(F.col("exam_name")).alias("exam_name"),
        F.when(d == 5, 0).otherwise(F.col("max_marks")).alias("max_marks"),
        F.when(d == 4, F.col("enrollment_id") + 10**9).otherwise(F.col("enrollment_id")).alias("enrollment_id"),
        F.when(d == 1, 1000).otherwise(F.col("marks_obtained")).alias("marks_obtained"), d.alias("d"))
    again = b.where("d = 3").withColumn("marks_obtained", F.lit(100).cast("long"))
    return b.withColumn("marks_obtained", F.col("marks_obtained").cast("long")).unionByName(again).withColumn("line", F.when(
        (F.col("d") == 3) & F.col("marks_obtained").eqNullSafe(F.lit(100)), 1).otherwise(0)).drop("d")


register("add_marks_rejected", """
, batch AS (
  SELECT se.enrollment_id % 10 AS d, sub.subject_id, CASE WHEN sub.subject_id % 2 = 0 THEN 'Final' ELSE 'Retest' END AS exam_name, se.enrollment_id,
         CASE WHEN se.roll_no % 23 <> 0 THEN (se.roll_no * 7 + sub.subject_id) % 101 END AS marks_obtained
    FROM student_enrollments se JOIN subjects sub ON sub.class_id = se.class_id
   WHERE se.status = 'active' AND se.academic_year_id IN (SELECT academic_year_id FROM academic_years WHERE is_active)
)
SELECT subject_id + CASE WHEN d = 2 THEN 1000000 ELSE 0 END AS subject_id, CASE WHEN d = 0 THEN repeat('x', 60) ELSE exam_name END AS exam_name,
       CAST(CASE WHEN d = 5 THEN 0 ELSE 100 END AS INTEGER) AS max_marks, enrollment_id + CASE WHEN d = 4 THEN 1000000000 ELSE 0 END AS enrollment_id,
       CAST(CASE WHEN d = 1 THEN 1000 WHEN d = 3 THEN 100 ELSE marks_obtained END AS BIGINT) AS marks_obtained,
       CASE d WHEN 0 THEN 'too_long:exam_name' WHEN 1 THEN 'bad_value:marks_obtained' WHEN 2 THEN 'missing_parent:subject_id'
              WHEN 3 THEN 'duplicate_in_batch:enrollment_id,subject_id,exam_id' WHEN 4 THEN 'missing_parent:enrollment_id' ELSE 'invalid_data' END AS reason
  FROM batch WHERE d <= 5
""")(lambda s: lifecycle.add_marks(s, bad_marks_batch(s), ["line"])[2])


# W10 with mappings that must be refused: by the class id without a target year, twice from one
# source, or to a class that is not in the target year.
def _bad_mappings(s) -> DataFrame:
    latest = s.academic_years.agg(F.max("academic_year_id")).scalar()
    c = s.classes.where(F.col("academic_year_id") == latest)
    kind = F.col("class_id") % 4
    m = c.select(F.col("academic_year_id").alias("from_year"), F.col("class_id").alias("from_class"),
                 F.when(kind != 1, F.col("academic_year_id")).alias("to_year"),
                 F.when(kind == 2, F.lit(999999)).when(kind == 3, F.col("class_id")).cast("long").alias("to_class"))
    return m.unionByName(m.where(F.col("from_class") % 4 == 0).withColumn("to_class", F.col("from_class")))


register("promote_refused", """
, latest AS (SELECT class_id, academic_year_id AS y, class_id % 4 AS kind FROM classes
              WHERE academic_year_id = (SELECT max(academic_year_id) FROM academic_years)),
busy AS (SELECT DISTINCT class_id FROM student_enrollments WHERE status = 'active'),
used AS (SELECT DISTINCT class_id FROM student_enrollments)
SELECT y AS from_year, class_id AS from_class, CASE WHEN kind <> 1 THEN y END AS to_year,
       CASE kind WHEN 0 THEN class_id WHEN 2 THEN 999999 WHEN 3 THEN class_id END AS to_class,
       CASE kind WHEN 0 THEN 'duplicate_source' WHEN 1 THEN 'missing_parameters'
            ELSE CASE WHEN class_id NOT IN (SELECT class_id FROM busy) THEN 'no_students'
                      WHEN kind = 2 THEN 'target_missing' ELSE 'already_promoted' END END AS reason
  FROM latest
UNION ALL
SELECT y, class_id, y, NULL, 'no_students' FROM latest WHERE kind = 0 AND class_id NOT IN (SELECT class_id FROM busy)
""")(lambda s: lifecycle.promote(s, _bad_mappings(s))[1])


# Roll over to a new year — create the year after the latest one and copies of its
# classes, then promote every class of the latest year one level up (level 10 passes).
def rollover(s):
    latest = s.academic_years.orderBy(F.desc("start_date"), F.desc("academic_year_id")).limit(1)
    y = F.year("start_date")
    new_year = latest.select(F.format_string("%d-%02d", y + 1, (y + 2) % 100).alias("year_name"),
                             F.add_months("start_date", 12).alias("start_date"),
                             F.add_months("end_date", 12).alias("end_date"))
    # Accepted rows are reused (parents, scalars, targets): materialise them once.
    # One row: no in-batch duplicates; its name may still clash with an existing year.
    years_acc = cut_lineage(append_rows(s, "academic_years", new_year, ["start_date"], check_batch=False)[0])
    s1 = append(s, "academic_years", years_acc)
    new_id = years_acc.agg(F.max("academic_year_id")).scalar()
    src = s.classes.join(latest.select("academic_year_id"), "academic_year_id")
    new_cls = src.select("class_level", "division", "class_teacher_id", new_id.alias("academic_year_id"))
    # Copies of one year's classes (distinct level/division) into a year that has none yet;
    # the class teacher reference is still checked.
    cls_acc = cut_lineage(append_rows(s1, "classes", new_cls, ["class_level", "division"],
                                      skip=("academic_year_id",), check_current=False, check_batch=False)[0])
    s2 = append(s1, "classes", cls_acc)
    tgt = cls_acc.select(F.col("class_id").alias("to_class"), (F.col("class_level") - 1).alias("class_level"),
                         "division")
    mapping = (src.join(tgt, ["class_level", "division"], "left")
               .select(F.col("academic_year_id").alias("from_year"), F.col("class_id").alias("from_class"),
                       new_id.alias("to_year"), "to_class"))
    return lifecycle.promote(s2, mapping)


register("promote", """
, latest AS (SELECT academic_year_id, start_date FROM academic_years
              ORDER BY start_date DESC, academic_year_id DESC LIMIT 1)
, new_year AS (SELECT (SELECT max(academic_year_id) FROM academic_years) + 1 AS id,
                      CAST((SELECT start_date FROM latest) + INTERVAL 1 YEAR AS DATE) AS start_date)
, src AS (SELECT * FROM classes WHERE academic_year_id = (SELECT academic_year_id FROM latest))
, new_cls AS (SELECT (SELECT max(class_id) FROM classes) + row_number() OVER (ORDER BY class_level, division)
                       AS class_id, class_level, division FROM src)
, mapping AS (SELECT s.academic_year_id AS from_year, s.class_id AS from_class, n.class_id AS to_class
                FROM src s LEFT JOIN new_cls n ON n.class_level = s.class_level + 1 AND n.division = s.division)
, ok AS (SELECT m.* FROM mapping m
          WHERE EXISTS (SELECT 1 FROM student_enrollments se WHERE se.status = 'active'
                          AND se.academic_year_id = m.from_year AND se.class_id = m.from_class))
, moved AS (SELECT se.student_master_id, ok.to_class, se.roll_no, se.user_id
              FROM student_enrollments se JOIN ok ON se.academic_year_id = ok.from_year
                                                 AND se.class_id = ok.from_class
             WHERE se.status = 'active' AND ok.to_class IS NOT NULL)
SELECT se.enrollment_id, se.student_master_id, se.academic_year_id, se.class_id, se.roll_no, se.admission_date,
       se.user_id,
       CASE WHEN ok.from_class IS NULL THEN se.status WHEN ok.to_class IS NULL THEN 'passed' ELSE 'promoted' END
         AS status
  FROM student_enrollments se LEFT JOIN ok ON ok.from_year = se.academic_year_id AND ok.from_class = se.class_id
UNION ALL
SELECT (SELECT max(enrollment_id) FROM student_enrollments) + row_number() OVER (ORDER BY to_class, roll_no),
       student_master_id, (SELECT id FROM new_year), to_class, roll_no, (SELECT start_date FROM new_year),
       user_id, 'active'
  FROM moved
""")(lambda s: rollover(s)[0])


def _latest_classes(s):
    """The latest year that has classes, and the sorted ids of its classes."""
    year = s.classes.agg(F.max("academic_year_id")).scalar()
    ids = s.classes.where(F.col("academic_year_id") == year).agg(F.array_sort(F.collect_list("class_id"))).scalar()
    return year, ids


_LATEST_SQL = """
, latest AS (
  SELECT list(class_id ORDER BY class_id) AS ids, max(academic_year_id) AS year FROM classes
   WHERE academic_year_id = (SELECT max(academic_year_id) FROM classes)
)"""


# Admit a sibling of every student into a class of the latest year; students without a last name
# come without a gender (refused), machinery-segment students reuse their own reg_no (refused).
def admission_batch(s) -> DataFrame:
    sm = s.student_master
    sid = F.col("student_master_id")
    year, ids = _latest_classes(s)
    return sm.select(
        F.when(F.col("address") == "MACHINERY", F.col("reg_no"))
         .otherwise(F.concat(F.lit("A"), sid.cast("string"))).alias("reg_no"),
        "fname", F.when(F.col("lname").isNull(), F.lit(None)).otherwise(F.col("gender")).alias("gender"),
        (F.lit(1000000000) + sid).cast("int").alias("roll_no"),
        F.get(ids, (sid % F.size(ids)).cast("int")).alias("class_id"),
        year.alias("academic_year_id"), F.lit(ADMIT_DAY).alias("admission_date"))


_ADMISSION_SQL = f"""{_LATEST_SQL}
, batch AS (
  SELECT CASE WHEN address = 'MACHINERY' THEN reg_no ELSE 'A' || CAST(student_master_id AS VARCHAR) END
           AS reg_no,
         fname, CASE WHEN lname IS NULL THEN NULL ELSE gender END AS gender,
         CAST(1000000000 + student_master_id AS INTEGER) AS roll_no,
         ids[1 + student_master_id % len(ids)] AS class_id, year AS academic_year_id, DATE '{ADMIT_DAY}' AS admission_date
    FROM student_master, latest
), ok AS (
  SELECT * FROM batch WHERE gender IS NOT NULL AND reg_no NOT IN (SELECT reg_no FROM student_master)
)
"""

register("admit_students", _ADMISSION_SQL + """
SELECT (SELECT max(student_master_id) FROM student_master) + row_number() OVER (ORDER BY reg_no)
         AS student_master_id,
       (SELECT max(enrollment_id) FROM student_enrollments) + row_number() OVER (ORDER BY reg_no) AS enrollment_id,
       reg_no, fname, gender, roll_no, class_id, academic_year_id, admission_date
  FROM ok
""")(lambda s: lifecycle.admit_students(s, admission_batch(s), ["reg_no"])[1].select(
    "student_master_id", "enrollment_id", "reg_no", "fname", "gender", "roll_no", "class_id",
    "academic_year_id", "admission_date"))

register("admit_students_rejected", _ADMISSION_SQL + """
SELECT reg_no, fname, roll_no, class_id, academic_year_id,
       CASE WHEN gender IS NULL THEN 'missing:gender' ELSE 'duplicate_key:reg_no' END AS reason
  FROM batch WHERE gender IS NULL OR reg_no IN (SELECT reg_no FROM student_master)
""")(lambda s: lifecycle.admit_students(s, admission_batch(s), ["reg_no"])[2].select(
    "reg_no", "fname", "roll_no", "class_id", "academic_year_id", "reason"))


# Register every employee again as new staff (employees with gender 'Other' come without
# a role and are refused) and every student as a new student login in a class of the latest year.
def registration_batch(s) -> DataFrame:
    eid, sid = F.col("employee_id"), F.col("student_master_id")
    staff = s.employees.select(
        "fname",
        F.when(F.col("gender") == "Other", F.lit(None))
         .when(eid % 10 == 0, F.lit("accountant")).otherwise(F.lit("teacher")).alias("role"),
        F.lit(HIRE_DAY).alias("date"), "salary", F.lit(None).cast("int").alias("roll_no"),
        F.concat(F.lit("R"), eid.cast("string")).alias("reg_no"), F.lit(None).cast("long").alias("class_id"))
    _, ids = _latest_classes(s)
    students = s.student_master.select(
        "fname", F.lit("student").alias("role"), F.lit(ADMIT_DAY).alias("date"),
        F.lit(None).cast("decimal(10,2)").alias("salary"), (F.lit(1500000000) + sid).cast("int").alias("roll_no"),
        F.concat(F.lit("G"), sid.cast("string")).alias("reg_no"),
        F.get(ids, (sid % F.size(ids)).cast("int")).alias("class_id"))
    return staff.unionByName(students)


register("register_people", """
, batch AS (
  SELECT fname,
         CASE WHEN gender = 'Other' THEN NULL WHEN employee_id % 10 = 0 THEN 'accountant' ELSE 'teacher' END
           AS role,
         'R' || CAST(employee_id AS VARCHAR) AS reg_no
    FROM employees
  UNION ALL
  SELECT fname, 'student', 'G' || CAST(student_master_id AS VARCHAR) FROM student_master
), ok AS (SELECT * FROM batch WHERE role IS NOT NULL)
SELECT (SELECT max(user_id) FROM users) + row_number() OVER (ORDER BY reg_no) AS user_id, reg_no AS username, role,
       CASE WHEN role <> 'student' THEN (SELECT max(employee_id) FROM employees)
            + row_number() OVER (PARTITION BY role = 'student' ORDER BY reg_no) END AS employee_id,
       CASE WHEN role = 'student' THEN (SELECT max(student_master_id) FROM student_master)
            + row_number() OVER (PARTITION BY role = 'student' ORDER BY reg_no) END AS student_master_id,
       CASE WHEN role = 'student' THEN (SELECT max(enrollment_id) FROM student_enrollments)
            + row_number() OVER (PARTITION BY role = 'student' ORDER BY reg_no) END AS enrollment_id
  FROM ok
""")(lambda s: lifecycle.register_people(s, registration_batch(s), ["reg_no"])[1])


# The same batch, with the class and year of each new enrollment.
def _register_all(s) -> DataFrame:
    after, accepted, _ = lifecycle.register_people(s, registration_batch(s), ["reg_no"])
    placed = after.student_enrollments.select("enrollment_id", "class_id", "academic_year_id")
    return accepted.select("user_id", "username", "role", "employee_id", "student_master_id", "enrollment_id").join(
        placed, "enrollment_id", "left")


register("register_all_people", _LATEST_SQL + """
, batch AS (
  SELECT CASE WHEN gender = 'Other' THEN NULL WHEN employee_id % 10 = 0 THEN 'accountant' ELSE 'teacher' END
           AS role,
         'R' || CAST(employee_id AS VARCHAR) AS reg_no, CAST(NULL AS BIGINT) AS class_id, CAST(NULL AS BIGINT) AS year
    FROM employees
  UNION ALL
  SELECT 'student', 'G' || CAST(student_master_id AS VARCHAR), ids[1 + student_master_id % len(ids)], year
    FROM student_master, latest
), ok AS (SELECT * FROM batch WHERE role IS NOT NULL)
SELECT (SELECT max(user_id) FROM users) + row_number() OVER (ORDER BY reg_no) AS user_id, reg_no AS username, role,
       CASE WHEN role <> 'student' THEN (SELECT max(employee_id) FROM employees)
            + row_number() OVER (PARTITION BY role = 'student' ORDER BY reg_no) END AS employee_id,
       CASE WHEN role = 'student' THEN (SELECT max(student_master_id) FROM student_master)
            + row_number() OVER (PARTITION BY role = 'student' ORDER BY reg_no) END AS student_master_id,
       CASE WHEN role = 'student' THEN (SELECT max(enrollment_id) FROM student_enrollments)
            + row_number() OVER (PARTITION BY role = 'student' ORDER BY reg_no) END AS enrollment_id,
       class_id, year AS academic_year_id
  FROM ok
""")(_register_all)


# Delete every inactive login and follow the foreign keys.
_NULLABLE_REFS = {"classes": "class_teacher_id", "student_enrollments": "user_id"}


def table_sizes(s) -> DataFrame:
    parts = []
    for name in SCHEMAS:
        df = s.table(name)
        col = _NULLABLE_REFS.get(name)
        nulls = F.count_if(F.col(col).isNull()) if col else F.lit(0).cast("long")
        parts.append(df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"),
                            nulls.alias("nulls")))
    return reduce(DataFrame.unionByName, parts)


def _delete_inactive(s):
    keys = s.users.where(F.col("status") == "inactive").select("user_id")
    return table_sizes(lifecycle.delete_cascade(s, "users", keys))


def _sizes_sql() -> str:
    gone = {
        "users": "user_id IN (SELECT user_id FROM del_users)",
        "employees": "employee_id IN (SELECT employee_id FROM del_emp)",
        "subjects": "subject_id IN (SELECT subject_id FROM del_sub)",
        "marks": "subject_id IN (SELECT subject_id FROM del_sub)",
    }
    nulls = {
        "classes": "class_teacher_id IS NULL OR class_teacher_id IN (SELECT employee_id FROM del_emp)",
        "student_enrollments": "user_id IS NULL OR user_id IN (SELECT user_id FROM del_users)",
    }
    parts = []
    for name in SCHEMAS:
        keep = f"NOT ({gone[name]})" if name in gone else "TRUE"
        n = f"count(*) FILTER (WHERE {nulls[name]})" if name in nulls else "CAST(0 AS BIGINT)"
        parts.append(f"SELECT '{name}' AS table_name, count(*) AS rows, {n} AS nulls FROM {name} WHERE {keep}")
    return "\nUNION ALL\n".join(parts)


def _delete_art(s):
    keys = s.subjects.where(F.col("subject_name") == "Art").select("subject_id")
    return table_sizes(lifecycle.delete_cascade(s, "subjects", keys))


register("delete_subjects", """
, del_sub AS (SELECT subject_id FROM subjects WHERE subject_name = 'Art')
""" + "\nUNION ALL\n".join(
    f"SELECT '{name}' AS table_name, count(*) AS rows, "
    + (f"count(*) FILTER (WHERE {col} IS NULL)" if col else "CAST(0 AS BIGINT)") + " AS nulls FROM "
    + name + (" WHERE subject_id NOT IN (SELECT subject_id FROM del_sub)" if name in ("subjects", "marks") else "")
    for name, col in [(t, _NULLABLE_REFS.get(t)) for t in SCHEMAS]))(_delete_art)

register("delete_cascade", """
, del_users AS (SELECT user_id FROM users WHERE status = 'inactive')
, del_emp AS (SELECT employee_id FROM employees WHERE user_id IN (SELECT user_id FROM del_users))
, del_sub AS (SELECT subject_id FROM subjects WHERE teacher_id IN (SELECT employee_id FROM del_emp))
""" + _sizes_sql())(_delete_inactive)


# What is left, row by row, after deleting classes without a teacher, the first year, students
# without a last name and employees of one gender.
def _deleted(s, table: str, keys):
    return lifecycle.delete_cascade(s, table, keys)


register("delete_classes_marks", """
, gone AS (SELECT class_id FROM classes WHERE class_teacher_id IS NULL)
SELECT mark_id, enrollment_id, subject_id, exam_id, CAST(marks_obtained AS DOUBLE) AS marks_obtained, CAST(max_marks AS DOUBLE) AS max_marks, grade FROM marks
 WHERE enrollment_id NOT IN (SELECT enrollment_id FROM student_enrollments SEMI JOIN gone USING (class_id))
   AND subject_id NOT IN (SELECT subject_id FROM subjects SEMI JOIN gone USING (class_id))
""")(lambda s: _deleted(s, "classes", s.classes.where("class_teacher_id IS NULL")).marks)

register("delete_year_payments", """
SELECT payment_id, enrollment_id, CAST(amount_paid AS DOUBLE) AS amount_paid, payment_date, payment_mode, receipt_no FROM fee_payments
 WHERE enrollment_id IN (SELECT enrollment_id FROM student_enrollments WHERE academic_year_id > (SELECT min(academic_year_id) FROM academic_years))
""")(lambda s: _deleted(s, "academic_years", s.academic_years.orderBy("academic_year_id").limit(1)).fee_payments)

register("delete_students_attendance", """
SELECT a.* FROM attendance_students a
  JOIN student_enrollments se ON se.enrollment_id = a.enrollment_id
  JOIN student_master sm ON sm.student_master_id = se.student_master_id
 WHERE sm.lname IS NOT NULL
""")(lambda s: _deleted(s, "student_master", s.student_master.where("lname IS NULL")).attendance_students)

register("delete_employees_classes", """
SELECT c.class_id, c.class_level, c.division, c.academic_year_id, e.employee_id AS class_teacher_id
  FROM classes c LEFT JOIN (SELECT employee_id FROM employees WHERE gender <> 'Other') e ON e.employee_id = c.class_teacher_id
""")(lambda s: _deleted(s, "employees", s.employees.where("gender = 'Other'")).classes)

register("delete_left_students_attendance", """
, gone AS (SELECT student_master_id FROM student_enrollments WHERE status = 'left')
SELECT a.* FROM attendance_students a JOIN student_enrollments se USING (enrollment_id) WHERE se.student_master_id NOT IN (SELECT student_master_id FROM gone)
""")(lambda s: _deleted(s, "student_master", s.student_enrollments.where("status = 'left'").select("student_master_id").distinct()).attendance_students)

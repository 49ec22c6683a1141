"""Registered audits (Q1–Q5).  The DuckDB statements are written from the same
declared rule lists (schema.py) but evaluated independently by DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.catalog import register
from rollbook.operators import audit, people, stored
from rollbook.operators.audit import decimal_columns
from rollbook.plans.dims import fresh_folder
from rollbook.sources.schema import (
    ALLOWED_VALUES, FOREIGN_KEYS, MAX_LENGTHS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS, not_null_columns)


def _lit(v) -> str:
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _unique_sql(prefix: str = "") -> str:
    parts = []
    for table in SCHEMAS:
        for cols in [(PRIMARY_KEYS[table],)] + list(UNIQUE_KEYS.get(table, [])):
            key = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"
            nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
            parts.append(f"SELECT '{table}' AS table_name, '{','.join(cols)}' AS columns, {key} AS key, "
                         f"count(*) AS n FROM {prefix}{table} WHERE {nn} GROUP BY {', '.join(cols)} HAVING count(*) > 1")
    return "\nUNION ALL\n".join(parts)


def _fk_sql(prefix: str = "") -> str:
    parts = []
    for child, col, parent, pk, _rule in FOREIGN_KEYS:
        parts.append(f"SELECT '{child}' AS child_table, '{col}' AS child_column, '{parent}' AS parent_table, "
                     f"CAST({col} AS BIGINT) AS value, count(*) AS n FROM {prefix}{child} "
                     f"WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT {pk} FROM {prefix}{parent}) GROUP BY {col}")
    return "\nUNION ALL\n".join(parts)


def _values_sql(prefix: str = "") -> str:
    parts = []
    for table in SCHEMAS:
        rules = [(f"not_null:{c}", f"{c} IS NULL") for c in not_null_columns(table)]
        rules += [(f"allowed:{c}", f"{c} IS NOT NULL AND {c} NOT IN ({', '.join(_lit(v) for v in vals)})")
                  for c, vals in ALLOWED_VALUES.get(table, {}).items()]
        rules += [(f"max_length:{c}", f"length({c}) > {n}") for c, n in MAX_LENGTHS.get(table, {}).items()]
        rules += [(f"range:{c}", f"abs({c}) >= {10 ** (p - sc)}") for c, (p, sc) in decimal_columns(table).items()]
        for name, pred in rules:
            parts.append(f"SELECT '{table}' AS table_name, '{name}' AS rule, "
                         f"count(*) FILTER (WHERE {pred}) AS violations FROM {prefix}{table}")
    return "\nUNION ALL\n".join(parts)


register("audit_unique", _unique_sql())(audit.audit_all_unique)

register("audit_assignment_duplicates", """
SELECT enrollment_id, count(*) AS n FROM student_fee_assignments GROUP BY enrollment_id HAVING count(*) > 1
""")(lambda s: audit.audit_unique(s.student_fee_assignments, ["enrollment_id"]))

register("audit_foreign_key", _fk_sql())(audit.audit_all_foreign_keys)

register("audit_values", _values_sql())(audit.audit_all_values)

def _closed_year_sql(prefix: str = "") -> str:
    return f"""
SELECT 'duplicate_enrollment' AS rule, student_master_id AS key, academic_year_id, CAST(NULL AS DATE) AS dated
  FROM {prefix}student_enrollments GROUP BY student_master_id, academic_year_id HAVING count(*) > 1
UNION ALL
SELECT 'admission_after_close', se.enrollment_id, se.academic_year_id, se.admission_date
  FROM {prefix}student_enrollments se JOIN closed c ON c.academic_year_id = se.academic_year_id
 WHERE se.admission_date > c.end_date
UNION ALL
SELECT 'attendance_after_close', a.attendance_id, se.academic_year_id, a.attendance_date
  FROM {prefix}attendance_students a JOIN {prefix}student_enrollments se ON se.enrollment_id = a.enrollment_id
  JOIN closed c ON c.academic_year_id = se.academic_year_id
 WHERE a.attendance_date > c.end_date
UNION ALL
SELECT 'mark_after_close', m.mark_id, se.academic_year_id, CAST(NULL AS DATE)
  FROM {prefix}marks m JOIN {prefix}student_enrollments se ON se.enrollment_id = m.enrollment_id
  JOIN closed c ON c.academic_year_id = se.academic_year_id JOIN {prefix}exams e ON e.exam_id = m.exam_id
 WHERE e.academic_year_id > se.academic_year_id
"""


def _class_year_sql(prefix: str = "") -> str:
    return f"""
SELECT se.class_id, se.enrollment_id, se.academic_year_id, c.academic_year_id AS class_year_id
  FROM {prefix}student_enrollments se JOIN {prefix}classes c ON c.class_id = se.class_id
 WHERE se.academic_year_id <> c.academic_year_id
"""


_CLOSED = """
, closed AS (SELECT academic_year_id, end_date FROM academic_years WHERE is_closed)
"""

register("audit_closed_year", _CLOSED + _closed_year_sql())(audit.audit_closed_year)

register("audit_enrollment_class_year", _class_year_sql())(audit.audit_enrollment_class_year)


# The same audits on tables in which some rows break the rules: classes of the next year or none, no such
# student, enrolled twice, dates and exams behind a closed year, one receipt for many, no teacher.
def _dirty(s):
    change = lambda df, col, when, value: df.withColumn(col, F.when(F.expr(when), F.expr(value)).otherwise(F.col(col)))
    enr = change(s.student_enrollments, "class_id", "roll_no % 50 = 0", "class_id + 30")
    enr = change(enr, "student_master_id", "roll_no % 70 = 0", "-student_master_id")
    enr = change(enr, "academic_year_id", "roll_no % 90 = 0", "least(academic_year_id + 1, 7007)")
    enr = change(enr, "admission_date", "roll_no % 110 = 0", "date_add(admission_date, 800)")
    return s.replace(
        student_enrollments=enr,
        attendance_students=change(s.attendance_students, "attendance_date", "attendance_id % 40 = 0", "date_add(attendance_date, 800)"),
        marks=change(s.marks, "exam_id", "mark_id % 50 = 0", "exam_id + 2"),
        fee_payments=change(s.fee_payments, "receipt_no", "payment_id % 30 = 0", "'RCP|1'"),
        subjects=change(s.subjects, "teacher_id", "subject_id % 9 = 0", "cast(null as bigint)"))


_CHANGED = {
    "student_enrollments": """CASE WHEN roll_no % 50 = 0 THEN class_id + 30 ELSE class_id END AS class_id,
        CASE WHEN roll_no % 70 = 0 THEN -student_master_id ELSE student_master_id END AS student_master_id,
        CASE WHEN roll_no % 90 = 0 THEN least(academic_year_id + 1, 7007) ELSE academic_year_id END AS academic_year_id,
        CASE WHEN roll_no % 110 = 0 THEN CAST(admission_date + 800 AS DATE) ELSE admission_date END AS admission_date""",
    "attendance_students": "CASE WHEN attendance_id % 40 = 0 THEN CAST(attendance_date + 800 AS DATE) ELSE attendance_date END AS attendance_date",
    "marks": "CASE WHEN mark_id % 50 = 0 THEN exam_id + 2 ELSE exam_id END AS exam_id",
    "fee_payments": "CASE WHEN payment_id % 30 = 0 THEN 'RCP|1' ELSE receipt_no END AS receipt_no",
    "subjects": "CASE WHEN subject_id % 9 = 0 THEN NULL ELSE teacher_id END AS teacher_id",
}
_DIRTY_SQL = "".join(f", dirty_{t} AS (SELECT * {f'REPLACE ({_CHANGED[t]})' if t in _CHANGED else ''} FROM {t})\n" for t in SCHEMAS)

register("audit_unique_dirty", _DIRTY_SQL + _unique_sql("dirty_"))(lambda s: audit.audit_all_unique(_dirty(s)))

register("audit_foreign_key_dirty", _DIRTY_SQL + _fk_sql("dirty_"))(lambda s: audit.audit_all_foreign_keys(_dirty(s)))

register("audit_closed_year_dirty", _DIRTY_SQL + _CLOSED + _closed_year_sql("dirty_"))(lambda s: audit.audit_closed_year(_dirty(s)))

register("audit_enrollment_class_year_dirty", _DIRTY_SQL + _class_year_sql("dirty_"))(lambda s: audit.audit_enrollment_class_year(_dirty(s)))

register("unassigned_subjects_dirty", _DIRTY_SQL + """
SELECT subject_id, subject_name, class_id, academic_year_id FROM dirty_subjects WHERE teacher_id IS NULL
""")(lambda s: people.unassigned_subjects(_dirty(s)).select("subject_id", "subject_name", "class_id", "academic_year_id"))


# Q3 while writing: every table is written, and its rules are counted on the way.
def _written_values(s) -> DataFrame:
    path = fresh_folder(s.spark, "written")
    return reduce(DataFrame.unionByName, [stored.write_observed(s.table(t), t, f"{path}/{t}") for t in SCHEMAS if audit.value_rules(t)])


register("write_observed_values", _values_sql())(_written_values)

register("write_observed_values_dirty", _DIRTY_SQL + _values_sql("dirty_"))(lambda s: _written_values(_dirty(s)))

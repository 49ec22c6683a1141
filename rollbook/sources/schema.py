"""Declared school tables: Spark schemas, allowed values, keys and foreign keys.

Every table is a DataFrame with an explicit StructType; the MySQL column
lengths, enums and keys of the original schema become audit rules (see
``rollbook.operators.audit``) because Parquet does not enforce them.
"""

from __future__ import annotations

from pyspark.sql import types as T

ID = T.LongType()
MONEY = T.DecimalType(10, 2)
MARK = T.DecimalType(5, 2)


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


SCHEMAS: dict[str, T.StructType] = {
    "academic_years": T.StructType([
        _f("academic_year_id", ID, False), _f("year_name", T.StringType(), False),
        _f("start_date", T.DateType(), False), _f("end_date", T.DateType(), False),
        _f("is_active", T.BooleanType()), _f("is_closed", T.BooleanType()),
        _f("created_at", T.TimestampNTZType()),
    ]),
    # The password column is never loaded (privacy); sign-in is not data work.
    "users": T.StructType([
        _f("user_id", ID, False), _f("username", T.StringType(), False),
        _f("role", T.StringType(), False), _f("status", T.StringType()),
        _f("created_at", T.TimestampNTZType()),
    ]),
    "employees": T.StructType([
        _f("employee_id", ID, False), _f("user_id", ID, False),
        _f("fname", T.StringType(), False), _f("lname", T.StringType()),
        _f("reg_no", T.StringType(), False), _f("gender", T.StringType()),
        _f("mobile", T.StringType()), _f("email", T.StringType()),
        _f("joining_date", T.DateType()), _f("salary", MONEY),
    ]),
    "classes": T.StructType([
        _f("class_id", ID, False), _f("class_level", T.IntegerType(), False),
        _f("division", T.StringType(), False), _f("academic_year_id", ID, False),
        _f("class_teacher_id", ID),
    ]),
    "student_master": T.StructType([
        _f("student_master_id", ID, False), _f("reg_no", T.StringType(), False),
        _f("fname", T.StringType(), False), _f("lname", T.StringType()),
        _f("mother_name", T.StringType()), _f("gender", T.StringType()),
        _f("dob", T.DateType()), _f("mobile", T.StringType()),
        _f("email", T.StringType()), _f("address", T.StringType()),
        _f("created_at", T.TimestampNTZType()),
    ]),
    "student_enrollments": T.StructType([
        _f("enrollment_id", ID, False), _f("student_master_id", ID, False),
        _f("academic_year_id", ID, False), _f("class_id", ID, False),
        _f("roll_no", T.IntegerType(), False), _f("admission_date", T.DateType(), False),
        _f("user_id", ID), _f("status", T.StringType()),
    ]),
    "subjects": T.StructType([
        _f("subject_id", ID, False), _f("subject_name", T.StringType(), False),
        _f("class_id", ID, False), _f("teacher_id", ID, False),
        _f("academic_year_id", ID, False),
    ]),
    "exams": T.StructType([
        _f("exam_id", ID, False), _f("exam_name", T.StringType(), False),
        _f("academic_year_id", ID, False),
    ]),
    "marks": T.StructType([
        _f("mark_id", ID, False), _f("enrollment_id", ID, False),
        _f("subject_id", ID, False), _f("exam_id", ID, False),
        _f("marks_obtained", MARK), _f("max_marks", MARK), _f("grade", T.StringType()),
    ]),
    "attendance_students": T.StructType([
        _f("attendance_id", ID, False), _f("enrollment_id", ID, False),
        _f("attendance_date", T.DateType(), False), _f("status", T.StringType(), False),
    ]),
    "fee_structures": T.StructType([
        _f("structure_id", ID, False), _f("class_level", T.IntegerType(), False),
        _f("academic_year_id", ID, False), _f("total_amount", MONEY, False),
    ]),
    "student_fee_assignments": T.StructType([
        _f("assignment_id", ID, False), _f("enrollment_id", ID, False),
        _f("total_amount", MONEY, False), _f("assigned_date", T.DateType(), False),
    ]),
    "fee_payments": T.StructType([
        _f("payment_id", ID, False), _f("enrollment_id", ID, False),
        _f("amount_paid", MONEY, False), _f("payment_date", T.DateType(), False),
        _f("payment_mode", T.StringType()), _f("receipt_no", T.StringType()),
    ]),
}

TABLES = tuple(SCHEMAS)

PRIMARY_KEYS: dict[str, str] = {
    "academic_years": "academic_year_id", "users": "user_id", "employees": "employee_id",
    "classes": "class_id", "student_master": "student_master_id",
    "student_enrollments": "enrollment_id", "subjects": "subject_id", "exams": "exam_id",
    "marks": "mark_id", "attendance_students": "attendance_id",
    "fee_structures": "structure_id", "student_fee_assignments": "assignment_id",
    "fee_payments": "payment_id",
}

# First id handed out per table (AUTO_INCREMENT start values of the schema).
ID_START: dict[str, int] = {
    "academic_years": 7001, "users": 1001, "employees": 2001, "classes": 3001,
    "student_master": 301, "student_enrollments": 501, "subjects": 5001, "exams": 8001,
    "marks": 9001, "attendance_students": 6001, "fee_structures": 1501,
    "student_fee_assignments": 2501, "fee_payments": 3501,
}

# Declared unique keys besides the primary keys (NULLs never clash).
UNIQUE_KEYS: dict[str, list[tuple[str, ...]]] = {
    "academic_years": [("year_name",)],
    "users": [("username",)],
    "employees": [("reg_no",), ("mobile",), ("email",)],
    "classes": [("class_level", "division", "academic_year_id")],
    "student_master": [("reg_no",)],
    "student_enrollments": [("student_master_id", "academic_year_id"), ("class_id", "roll_no")],
    "exams": [("exam_name", "academic_year_id")],
    "marks": [("enrollment_id", "subject_id", "exam_id")],
    "attendance_students": [("enrollment_id", "attendance_date")],
    "fee_structures": [("class_level", "academic_year_id")],
    "fee_payments": [("receipt_no",)],
}

# Foreign keys: (child table, child column, parent table, parent column, on delete).
FOREIGN_KEYS: list[tuple[str, str, str, str, str]] = [
    ("employees", "user_id", "users", "user_id", "cascade"),
    ("classes", "academic_year_id", "academic_years", "academic_year_id", "cascade"),
    ("classes", "class_teacher_id", "employees", "employee_id", "set null"),
    ("student_enrollments", "student_master_id", "student_master", "student_master_id", "cascade"),
    ("student_enrollments", "academic_year_id", "academic_years", "academic_year_id", "cascade"),
    ("student_enrollments", "class_id", "classes", "class_id", "cascade"),
    ("student_enrollments", "user_id", "users", "user_id", "set null"),
    ("subjects", "class_id", "classes", "class_id", "cascade"),
    ("subjects", "teacher_id", "employees", "employee_id", "cascade"),
    ("subjects", "academic_year_id", "academic_years", "academic_year_id", "cascade"),
    ("exams", "academic_year_id", "academic_years", "academic_year_id", "cascade"),
    ("marks", "enrollment_id", "student_enrollments", "enrollment_id", "cascade"),
    ("marks", "subject_id", "subjects", "subject_id", "cascade"),
    ("marks", "exam_id", "exams", "exam_id", "cascade"),
    ("attendance_students", "enrollment_id", "student_enrollments", "enrollment_id", "cascade"),
    ("fee_structures", "academic_year_id", "academic_years", "academic_year_id", "cascade"),
    ("student_fee_assignments", "enrollment_id", "student_enrollments", "enrollment_id", "cascade"),
    ("fee_payments", "enrollment_id", "student_enrollments", "enrollment_id", "cascade"),
]

# Fixed values of the declared schema (ENUM members, column lengths, defaults).
ROLES = ("admin", "teacher", "accountant", "student")
USER_STATUSES = ("active", "inactive")
GENDERS = ("Male", "Female", "Other")
CLASS_LEVELS = tuple(range(1, 11))
DIVISIONS = ("A", "B", "C")
ATTENDANCE_STATUSES = ("Present", "Absent")
PAYMENT_MODES = ("Cash", "UPI", "Bank")
# 'promoted' is written by promotion; it is added here so the promote intent is valid.
ENROLLMENT_STATUSES = ("active", "passed", "failed", "left", "promoted")

ALLOWED_VALUES: dict[str, dict[str, tuple]] = {
    "users": {"role": ROLES, "status": USER_STATUSES},
    "employees": {"gender": GENDERS},
    "classes": {"class_level": CLASS_LEVELS, "division": DIVISIONS},
    "student_master": {"gender": GENDERS},
    "student_enrollments": {"status": ENROLLMENT_STATUSES},
    "attendance_students": {"status": ATTENDANCE_STATUSES},
    "fee_structures": {"class_level": CLASS_LEVELS},
    "fee_payments": {"payment_mode": PAYMENT_MODES},
}

MAX_LENGTHS: dict[str, dict[str, int]] = {
    "academic_years": {"year_name": 9},
    "users": {"username": 50},
    "employees": {"fname": 50, "lname": 50, "reg_no": 20, "mobile": 15, "email": 100},
    "student_master": {"reg_no": 20, "fname": 50, "lname": 50, "mother_name": 50,
                       "mobile": 15, "email": 100, "address": 200},
    "subjects": {"subject_name": 50},
    "exams": {"exam_name": 50},
    "marks": {"grade": 5},
    "fee_payments": {"receipt_no": 50},
}

# Column defaults applied by appends (W1) when the batch leaves them NULL.
DEFAULTS: dict[str, dict[str, object]] = {
    "academic_years": {"is_active": False, "is_closed": False},
    "users": {"status": "active"},
    "student_enrollments": {"status": "active"},
    "fee_payments": {"payment_mode": "Cash"},
}


# Tables with rows for years and their classes; all others grow with students and staff.
BY_YEAR = ("academic_years", "classes", "subjects", "exams", "fee_structures")


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields if not f.nullable]

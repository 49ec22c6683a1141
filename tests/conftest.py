"""Shared fixtures: one local SparkSession and a builder for tiny hand-made schools."""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from rollbook.sources.schema import SCHEMAS  # noqa: E402
from rollbook.sources.store import School  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("rollbook-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-tests-ckpt-", dir="/tmp"))
    yield s


def D(x) -> decimal.Decimal:  # noqa: N802
    return decimal.Decimal(str(x)).quantize(decimal.Decimal("0.01"))


def day(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def _row(table: str, values: dict) -> tuple:
    out = []
    for f in SCHEMAS[table].fields:
        v = values.get(f.name)
        if isinstance(v, (int, float)) and f.dataType.typeName() == "decimal":
            v = D(v)
        if isinstance(v, str) and f.dataType.typeName() == "date":
            v = day(v)
        out.append(v)
    return tuple(out)


def make_school(spark, **tables: list[dict]) -> School:
    """A School whose tables are the given rows (dicts; missing columns NULL, missing tables empty)."""
    frames = {}
    for name, schema in SCHEMAS.items():
        rows = [_row(name, r) for r in tables.get(name, [])]
        frames[name] = spark.createDataFrame(rows, schema)
    return School(**frames)


YEARS = [
    {"academic_year_id": 7001, "year_name": "2023-24", "start_date": "2023-01-01", "end_date": "2023-12-31",
     "is_active": False, "is_closed": True},
    {"academic_year_id": 7002, "year_name": "2024-25", "start_date": "2024-01-01", "end_date": "2024-12-31",
     "is_active": True, "is_closed": False},
]


@pytest.fixture
def base_rows():
    """A small school: one active year, two classes, four students, two teachers."""
    return dict(
        academic_years=list(YEARS),
        users=[{"user_id": 1, "username": "admin", "role": "admin", "status": "active"},
               {"user_id": 10, "username": "E1", "role": "teacher", "status": "active"},
               {"user_id": 11, "username": "E2", "role": "accountant", "status": "inactive"},
               {"user_id": 20, "username": "S1", "role": "student", "status": "active"},
               {"user_id": 21, "username": "S2", "role": "student", "status": "inactive"}],
        employees=[{"employee_id": 2001, "user_id": 10, "fname": "Tara", "lname": None, "reg_no": "E1"},
                   {"employee_id": 2002, "user_id": 11, "fname": "Omar", "lname": "Diaz", "reg_no": "E2"}],
        classes=[{"class_id": 3001, "class_level": 9, "division": "A", "academic_year_id": 7002,
                  "class_teacher_id": 2001},
                 {"class_id": 3002, "class_level": 10, "division": "A", "academic_year_id": 7002},
                 {"class_id": 3003, "class_level": 9, "division": "A", "academic_year_id": 7001}],
        student_master=[{"student_master_id": 301, "reg_no": "S1", "fname": "Ann", "lname": "Lee"},
                        {"student_master_id": 302, "reg_no": "S2", "fname": "Bo", "lname": None},
                        {"student_master_id": 303, "reg_no": "S3", "fname": "Cy", "lname": "Ng"},
                        {"student_master_id": 304, "reg_no": "S4", "fname": "Di", "lname": "Ro"}],
        student_enrollments=[
            {"enrollment_id": 501, "student_master_id": 301, "academic_year_id": 7002, "class_id": 3001,
             "roll_no": 1, "admission_date": "2024-01-01", "user_id": 20, "status": "active"},
            {"enrollment_id": 502, "student_master_id": 302, "academic_year_id": 7002, "class_id": 3001,
             "roll_no": 2, "admission_date": "2024-01-01", "user_id": 21, "status": "active"},
            {"enrollment_id": 503, "student_master_id": 303, "academic_year_id": 7002, "class_id": 3002,
             "roll_no": 1, "admission_date": "2024-01-01", "status": "active"},
            {"enrollment_id": 504, "student_master_id": 304, "academic_year_id": 7001, "class_id": 3003,
             "roll_no": 1, "admission_date": "2023-01-01", "status": "active"}],
        subjects=[{"subject_id": 5001, "subject_name": "Maths", "class_id": 3001, "teacher_id": 2001,
                   "academic_year_id": 7002},
                  {"subject_id": 5002, "subject_name": "Art", "class_id": 3001, "teacher_id": 2001,
                   "academic_year_id": 7002}],
        exams=[{"exam_id": 8001, "exam_name": "Final", "academic_year_id": 7002}],
        fee_structures=[{"structure_id": 1501, "class_level": 9, "academic_year_id": 7002, "total_amount": 1000}],
    )

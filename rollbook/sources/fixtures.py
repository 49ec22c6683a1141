"""Derive the school tables from the driver's TPC-H-style tables (FIXTURES.md).

The reference ships no data, so test tables are computed from ``customer``,
``supplier``, ``orders``, ``lineitem`` and ``events`` by integer arithmetic
that DuckDB repeats in ``rollbook.sources.fixtures_sql``.  Years and classes are
those that customers are enrolled in; subjects, exams and fee levels hang on
them.  No table is made up beside the input tables, but for the one admin user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.exprs import grade
from rollbook.plans.dims import by_key
from rollbook.sources.schema import MARK, MONEY
from rollbook.sources.store import School, conform

FIRST_YEAR = 1995
N_YEARS = 7
ACTIVE_Y = 5

# Fixed values of the fixture mapping (FIXTURES.md).
SUBJECT_NAMES = ["Maths", "Science", "English", "History", "Art"]
EXAM_NAMES = ["Unit Test", "Midterm", "Final"]
DIVISION_NAMES = ["A", "B", "C"]
GENDER_NAMES = ["Male", "Female", "Other"]


def _pick(names: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (idx + 1).cast("int"))


def _year_start(y: Column) -> Column:
    return F.make_date((F.lit(FIRST_YEAR) + y).cast("int"), F.lit(1), F.lit(1))


def _years(cy: DataFrame) -> DataFrame:
    y = F.col("y")
    return cy.select(y).distinct().select(
        (7001 + y).alias("academic_year_id"),
        F.format_string("%d-%02d", FIRST_YEAR + y, (FIRST_YEAR + 1 + y) % 100).alias("year_name"),
        _year_start(y).alias("start_date"),
        F.make_date((FIRST_YEAR + y).cast("int"), F.lit(12), F.lit(31)).alias("end_date"),
        (y == ACTIVE_Y).alias("is_active"),
        (y < ACTIVE_Y).alias("is_closed"),
        _year_start(y).cast("timestamp_ntz").alias("created_at"),
    )


def _class_places(cy: DataFrame) -> DataFrame:
    """(y, o, ord) of each class with an enrollment: o = 3 * level + division, ord = 30 * y + o."""
    ck, y = F.col("c_custkey"), F.col("y")
    return (cy.select(y, (3 * ((ck + y) % 10) + ck % 3).alias("o")).distinct()
            .withColumn("ord", 30 * F.col("y") + F.col("o")))


def _classes(places: DataFrame) -> DataFrame:
    o, ordc = F.col("o"), F.col("ord")
    return places.select(
        (3001 + ordc).alias("class_id"),
        (1 + F.floor(o / 3)).cast("int").alias("class_level"),
        _pick(DIVISION_NAMES, o % 3).alias("division"),
        (7001 + F.col("y")).alias("academic_year_id"),
        F.when(ordc % 7 == 0, F.lit(None)).otherwise(2001 + ordc % 9).alias("class_teacher_id"),
    )


def _subjects(places: DataFrame) -> DataFrame:
    sid = 5 * F.col("ord") + F.col("k")
    return (places.where(F.col("o") != 29)
            .select("y", "ord", F.explode(F.array(*[F.lit(k).cast("long") for k in range(5)])).alias("k"))
            .select((5001 + sid).alias("subject_id"),
                    _pick(SUBJECT_NAMES, F.col("k")).alias("subject_name"),
                    (3001 + F.col("ord")).alias("class_id"),
                    (2001 + sid % 9).alias("teacher_id"),
                    (7001 + F.col("y")).alias("academic_year_id")))


def _exams(cy: DataFrame) -> DataFrame:
    y, e = F.col("y"), F.col("e")
    return (cy.select(y).distinct().select(y, F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("e"))
            .select((8001 + 3 * y + e).alias("exam_id"), _pick(EXAM_NAMES, e).alias("exam_name"),
                    (7001 + y).alias("academic_year_id")))


def _fee_structures(places: DataFrame) -> DataFrame:
    i = 10 * F.col("y") + F.col("level") - 1
    return (places.select("y", (1 + F.floor(F.col("o") / 3)).alias("level")).distinct()
            .where(i != 10 * ACTIVE_Y + 9)
            .select((1501 + i).alias("structure_id"), F.col("level").cast("int").alias("class_level"),
                    (7001 + F.col("y")).alias("academic_year_id"),
                    (40000 + 30000 * F.col("level")).cast(MONEY).alias("total_amount")))


def _enrollment_cols(ck: Column, y: Column) -> list[Column]:
    return [
        (501 + 7 * ck + y).alias("enrollment_id"),
        (301 + ck).alias("student_master_id"),
        (7001 + y).alias("academic_year_id"),
        (3001 + 30 * y + 3 * ((ck + y) % 10) + ck % 3).alias("class_id"),
        (1 + ck).cast("int").alias("roll_no"),
        _year_start(y).alias("admission_date"),
        F.when(ck % 11 == 0, F.lit(None)).otherwise(1001 + ck).alias("user_id"),
        F.when((ck + y) % 17 == 0, "left").when((ck + y) % 19 == 0, "failed")
         .otherwise("active").alias("status"),
    ]


def derive_school(spark: SparkSession, sf_dir: str) -> School:
    """Build every school table from the parquet tables under ``sf_dir``."""
    def rd(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    customer = rd("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    supplier = rd("supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    ck, sk = F.col("c_custkey"), F.col("s_suppkey")
    base_day = F.make_date(F.lit(2000), F.lit(1), F.lit(1))

    users = (
        customer.select((1001 + ck).alias("user_id"), F.concat(F.lit("S"), ck.cast("string")).alias("username"),
                        F.lit("student").alias("role"),
                        F.when(ck % 13 == 0, "inactive").otherwise("active").alias("status"),
                        F.date_add(base_day, (ck % 365).cast("int")).cast("timestamp_ntz").alias("created_at"))
        .unionByName(supplier.select(
            (10000001 + sk).alias("user_id"), F.concat(F.lit("E"), sk.cast("string")).alias("username"),
            F.when(sk % 10 == 9, "accountant").otherwise("teacher").alias("role"),
            F.when(sk % 13 == 0, "inactive").otherwise("active").alias("status"),
            F.date_add(base_day, (sk % 365).cast("int")).cast("timestamp_ntz").alias("created_at")))
        .unionByName(spark.range(1).select(
            F.lit(1).cast("long").alias("user_id"), F.lit("admin").alias("username"),
            F.lit("admin").alias("role"), F.lit("active").alias("status"),
            base_day.cast("timestamp_ntz").alias("created_at"))))

    employees = supplier.select(
        (2001 + sk).alias("employee_id"), (10000001 + sk).alias("user_id"),
        F.col("s_name").alias("fname"),
        F.when(sk % 4 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("lname"),
        F.concat(F.lit("E"), sk.cast("string")).alias("reg_no"),
        _pick(GENDER_NAMES, sk % 3).alias("gender"),
        F.concat(F.lit("M"), sk.cast("string")).alias("mobile"),
        F.concat(F.lit("e"), sk.cast("string"), F.lit("@x")).alias("email"),
        F.date_add(F.make_date(F.lit(1990), F.lit(1), F.lit(1)), sk.cast("int")).alias("joining_date"),
        F.col("s_acctbal").cast(MONEY).alias("salary"))

    student_master = customer.select(
        (301 + ck).alias("student_master_id"), F.concat(F.lit("S"), ck.cast("string")).alias("reg_no"),
        F.col("c_name").alias("fname"),
        F.when(ck % 5 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("lname"),
        F.lit(None).cast("string").alias("mother_name"),
        _pick(GENDER_NAMES, ck % 3).alias("gender"),
        F.date_add(F.make_date(F.lit(1985), F.lit(1), F.lit(1)), (ck % 3650).cast("int")).alias("dob"),
        F.concat(F.lit("M"), ck.cast("string")).alias("mobile"),
        F.when(ck % 3 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("s"), ck.cast("string"), F.lit("@x"))).alias("email"),
        F.col("c_mktsegment").alias("address"),
        base_day.cast("timestamp_ntz").alias("created_at"))

    # What grows with the students is dealt over as many tasks as the session has shuffle partitions: by
    # compressed bytes (2 a customer, 8 a slot of marks) Spark would give millions of rows, once they are
    # exploded and are groups in memory, to one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # One row per (customer, year) with (ck + y) % 4 <> 3: explode a year list per customer.
    def by_years(customers: DataFrame) -> DataFrame:
        return (customers.select(ck, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_YEARS - 1).cast("long"))).alias("y"))
                .where((ck + F.col("y")) % 4 != 3))

    # Years and classes are a few groups in any task.
    cy, enrolled = by_years(customer), by_years(customer.select(ck).repartition(tasks, ck))
    enrollments = enrolled.select(*_enrollment_cols(ck, F.col("y")))

    # Orders mapped to the enrollment of their customer in the order's year: a customer is
    # enrolled in it by the rule of ``cy``, so the join needs the customers and not all their years.
    orders = rd("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    oy = (F.year("o_orderdate") - FIRST_YEAR).cast("long")
    order_enr = (orders.withColumn("y", oy).where(F.col("y").between(0, N_YEARS - 1) & ((F.col("o_custkey") + F.col("y")) % 4 != 3))
                 .join(by_key(customer.select(ck.alias("o_custkey"))), "o_custkey", "inner")
                 .withColumn("enrollment_id", 501 + 7 * F.col("o_custkey") + F.col("y")))

    fee_payments = order_enr.select(
        (3501 + F.col("o_orderkey")).alias("payment_id"), "enrollment_id",
        F.col("o_totalprice").cast(MONEY).alias("amount_paid"),
        F.to_date("o_orderdate").alias("payment_date"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "UPI")
         .when(F.col("o_orderpriority") == "5-LOW", "Bank").otherwise("Cash").alias("payment_mode"),
        F.concat(F.lit("RCP"), F.col("o_orderkey").cast("string")).alias("receipt_no"))

    # Marks: line items of an enrollment's orders, one mark per (subject, exam) slot.
    cls_o = 3 * ((F.col("o_custkey") + F.col("y")) % 10) + F.col("o_custkey") % 3
    lineitem = rd("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    slots = (order_enr.where(cls_o != 29)
             .select("o_orderkey", "o_custkey", "y", "enrollment_id", (30 * F.col("y") + cls_o).alias("ord"))
             .join(by_key(lineitem.withColumnRenamed("l_orderkey", "o_orderkey")), "o_orderkey", "inner")
             .repartition(tasks, "enrollment_id")
             .groupBy("enrollment_id", "o_custkey", "y", "ord",
                      (F.col("l_partkey") % 5).alias("k"), (F.col("l_linenumber") % 3).alias("e"))
             .agg(F.max("l_quantity").alias("q")))
    obtained = F.when((F.col("o_custkey") + F.col("k")) % 29 == 0, F.lit(None)).otherwise(2 * F.col("q")).cast(MARK)
    marks = slots.select(
        (100 * F.col("enrollment_id") + 10 * F.col("k") + F.col("e")).alias("mark_id"), "enrollment_id",
        (5001 + 5 * F.col("ord") + F.col("k")).alias("subject_id"),
        (8001 + 3 * F.col("y") + F.col("e")).alias("exam_id"),
        obtained.alias("marks_obtained"), F.lit(100).cast(MARK).alias("max_marks"))
    marks = marks.withColumn("grade", grade("marks_obtained", "max_marks"))

    # Attendance: a day with any 'error' event of the student is an absence (active year only).
    events = rd("events").select("ts", "user_id", "event_type")
    active_cy = enrolled.where(F.col("y") == ACTIVE_Y).select(F.col("c_custkey").alias("user_id"))
    attendance = (events.join(by_key(active_cy), "user_id", "inner")
                  .groupBy("user_id", F.to_date("ts").alias("attendance_date"))
                  .agg(F.max((F.col("event_type") == "error").cast("int")).alias("absent"))
                  .select((100 * (501 + 7 * F.col("user_id") + ACTIVE_Y) + F.dayofmonth("attendance_date"))
                          .alias("attendance_id"),
                          (501 + 7 * F.col("user_id") + ACTIVE_Y).alias("enrollment_id"),
                          "attendance_date",
                          F.when(F.col("absent") == 1, "Absent").otherwise("Present").alias("status")))

    places = _class_places(cy)
    classes = _classes(places)
    fee_structures = _fee_structures(places)
    years = _years(cy)
    # Fee assignment per enrollment from the level's structure; some get a duplicate copy.  A class has one
    # level and year, so level, amount and start are joined to the few classes first, and what is broadcast to
    # the enrollments has one integer key (1 MB): by two keys each copy would take a memory page (up to 64 MB).
    class_fees = (classes.select("class_id", "class_level", "academic_year_id")
                  .join(by_key(fee_structures.select("class_level", "academic_year_id", "total_amount")),
                        ["class_level", "academic_year_id"])
                  .join(by_key(years.select("academic_year_id", "start_date")), "academic_year_id"))
    assign = (enrollments.where(F.col("enrollment_id") % 9 != 0)
              .join(F.broadcast(class_fees.select("class_id", "total_amount", "start_date")), "class_id")
              .select("enrollment_id", "total_amount", F.col("start_date").alias("assigned_date"),
                      F.explode(F.when(F.col("enrollment_id") % 50 == 1, F.array(F.lit(0), F.lit(1)))
                                .otherwise(F.array(F.lit(0)))).alias("copy")))
    assignments = assign.select((2 * F.col("enrollment_id") + F.col("copy")).alias("assignment_id"),
                                "enrollment_id", "total_amount", "assigned_date")

    tables = dict(
        academic_years=years, users=users, employees=employees, classes=classes,
        student_master=student_master, student_enrollments=enrollments, subjects=_subjects(places),
        exams=_exams(cy), marks=marks, attendance_students=attendance,
        fee_structures=fee_structures, student_fee_assignments=assignments, fee_payments=fee_payments)
    return School(**{k: conform(v, k) for k, v in tables.items()})

"""Set-based table changes, part 2 (W9–W13): marks entry, promotion,
admission, registration and cascading delete.

The reference runs these as row loops inside a transaction.  Here each
decision is a join over the whole batch: acceptance is decided first on a
checkpointed frame, then every output is derived from it, so a row refused
on one table is refused on all.  Parquet has no cross-table transaction;
callers write the outputs to fresh paths and switch once all are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.exprs import grade
from rollbook.operators.changes import (
    REASON, append_rows, assign_ids, inspect_batch, next_id_base, settle, spread_nulls)
from rollbook.plans.dims import by_key, cut_lineage
from rollbook.sources.schema import BY_YEAR, FOREIGN_KEYS, ID_START, MAX_LENGTHS, PRIMARY_KEYS, SCHEMAS
from rollbook.sources.store import School, conform


# ---------------------------------------------------------------------------------------------
# W9

def add_marks(s: School, batch: DataFrame, order_by: list[str] | None = None,
              enforce_closed: bool = False) -> tuple[School, DataFrame, DataFrame]:
    """Batch (subject_id, exam_name, max_marks, enrollment_id, marks_obtained).

    The exam is found by (exam_name, the subject's year) and created when missing; the
    grade is computed; stored marks of an accepted (enrollment, subject, exam) are replaced
    (new ids, as delete + insert).  Every batch row is accepted or refused with a reason, and
    refused rows keep their columns: a number that does not fit its column is ``bad_value``,
    an exam that cannot be created refuses its marks.  Of rows of one triple the first by
    ``order_by`` (default: the marks, then the position in the batch) is taken.
    Returns (new school, accepted mark rows, refused batch rows).
    """
    given = ["subject_id", "exam_name", "max_marks", "enrollment_id", "marks_obtained"]
    order_by = order_by or ["marks_obtained", "max_marks"]
    b = cut_lineage(batch.select(*given, *[c for c in order_by if c not in given])).withColumn("_line", F.monotonically_increasing_id())
    number = lambda c: F.col(c).try_cast("decimal(5,2)")
    missing = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in ("subject_id", "exam_name", "max_marks", "enrollment_id")])
    years = s.subjects.select("subject_id", "academic_year_id")
    b = (b.join(years, "subject_id", "left")
         .withColumn("_got", number("marks_obtained")).withColumn("_max", number("max_marks"))
         .withColumn("_pre", F.when(missing | (F.col("_max") == 0), F.lit("invalid_data"))
                     .when(F.col("_max").isNull(), F.lit("bad_value:max_marks"))
                     .when(F.col("marks_obtained").isNotNull() & F.col("_got").isNull(), F.lit("bad_value:marks_obtained"))
                     .when(F.length("exam_name") > MAX_LENGTHS["exams"]["exam_name"], F.lit("too_long:exam_name"))
                     .when(F.col("academic_year_id").isNull(), F.lit("missing_parent:subject_id"))))
    b = cut_lineage(b)
    ok = b.where(F.col("_pre").isNull())
    order = [*order_by, "_line"]

    # Which marks can be stored is settled before an exam is created: one of a triple, with its enrollment.
    named = ok.select("_line", *order_by, "enrollment_id", "subject_id", "exam_name", "academic_year_id")
    first = named.groupBy("enrollment_id", "subject_id", "exam_name").agg(F.min(F.struct(*order)).alias("_first"))
    closed = s.academic_years.where(F.col("is_closed").eqNullSafe(True)).select("academic_year_id") if enforce_closed else None
    wanted = named.select("enrollment_id").distinct()
    orphans = wanted.join(by_key(s.student_enrollments.select("enrollment_id")), "enrollment_id", "left_anti").withColumn("_orphan", F.lit(True))
    judged = named.join(by_key(first), ["enrollment_id", "subject_id", "exam_name"]).join(by_key(orphans), "enrollment_id", "left")
    reason = (F.when(F.col("_orphan"), F.lit("missing_parent:enrollment_id"))
              .when(F.struct(*order) != F.col("_first"), F.lit("duplicate_in_batch:enrollment_id,subject_id,exam_id")))
    if closed is not None:
        shut = s.student_enrollments.join(closed, "academic_year_id", "left_semi").select("enrollment_id").withColumn("_shut", F.lit(True))
        judged = judged.join(by_key(shut), "enrollment_id", "left").join(closed.withColumn("_shut_year", F.lit(True)), "academic_year_id", "left")
        reason = reason.when(F.col("_shut") | F.col("_shut_year"), F.lit("closed_year"))
    judged = cut_lineage(judged.select("_line", reason.alias("_late")))
    b = b.join(by_key(judged), "_line", "left").withColumn(REASON, F.coalesce("_pre", "_late"))
    rejected = b.where(F.col(REASON).isNotNull()).select(*given, REASON)
    good = b.where(F.col(REASON).isNull())

    # Distinct pairs, absent from the table, years taken from subjects: nothing left to check.
    exam = ["exam_name", "academic_year_id"]
    missing_exams = good.select(*exam).distinct().join(s.exams.select(*exam), exam, "left_anti")
    new_exams, _proven = append_rows(s, "exams", missing_exams, ["academic_year_id", "exam_name"],
                                     skip=("academic_year_id",), check_current=False, check_batch=False)
    exams = s.exams.unionByName(new_exams)
    rows = (good.join(exams.select("exam_id", *exam), exam)
            .select("enrollment_id", "subject_id", "exam_id", F.col("_got").alias("marks_obtained"), F.col("_max").alias("max_marks"),
                    grade("_got", "_max").alias("grade")))
    key = ["enrollment_id", "subject_id", "exam_id"]
    # Distinct triples with their parents: all are accepted.
    accepted, _proven = append_rows(s.replace(exams=exams), "marks", rows, key, skip=("subject_id", "exam_id", "enrollment_id"),
                                    check_current=False, check_batch=False)
    kept = conform(s.marks.join(by_key(accepted.select(*key)), key, "left_anti"), "marks")
    return s.replace(exams=exams, marks=kept.unionByName(accepted)), accepted, rejected


# ---------------------------------------------------------------------------------------------
# W10

def promote(s: School, mapping: DataFrame, enforce_closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Mapping (from_year, from_class, to_year, to_class) → (new enrollments, refused mappings).

    Per mapping, as one transaction of the reference:
      * no source, or no target year → ``missing_parameters``;
      * with ``enforce_closed``, a source or target year that is closed → ``closed_year``;
      * a source class counts once, by its least (to_year, to_class) → the others ``duplicate_source``;
      * no 'active' student in the source class → refused ``no_students``;
      * no target class → every row of the source class becomes 'passed';
      * target must exist in the target year (``target_missing``), be empty
        (``already_promoted``), be named by one mapping only (``duplicate_target``)
        and hold none of the students already in the target year
        (``student_already_enrolled``); of mappings that would enrol one student
        twice in a year the least (from_year, from_class) counts (``duplicate_student``);
      * accepted: each active student is copied with its roll number (status
        'active', admission on the target year's start, same login), then every
        row of the source class becomes 'promoted'.
    """
    m = mapping.select(
        F.col("from_year").cast("long"), F.col("from_class").cast("long"),
        F.col("to_year").cast("long"), F.col("to_class").cast("long"))
    enr = s.student_enrollments
    active = enr.where(F.col("status") == "active").select(
        F.col("academic_year_id").alias("from_year"), F.col("class_id").alias("from_class"),
        "student_master_id", "roll_no", "user_id")
    # One pass over enrollments per (year, class): active students and any rows at all.
    per_class = enr.groupBy("academic_year_id", "class_id").agg(
        F.count_if(F.col("status") == "active").alias("n_active"))
    n_active = per_class.select(F.col("academic_year_id").alias("from_year"),
                                F.col("class_id").alias("from_class"), "n_active")
    targets = s.classes.select(F.col("class_id").alias("to_class"), F.col("academic_year_id").alias("to_year"))
    occupied = per_class.select(F.col("academic_year_id").alias("to_year"), F.col("class_id").alias("to_class"))
    # One row for each closed year.
    closed = s.academic_years.where(F.col("is_closed").eqNullSafe(True) & F.lit(enforce_closed)).select(F.col("academic_year_id").alias("year"))
    # Repeated mappings are told apart by their position, so each keeps its own verdict.
    m = cut_lineage(m).withColumn("_line", F.monotonically_increasing_id())
    target = F.struct(F.coalesce("to_year", F.lit(0)), F.coalesce("to_class", F.lit(0)), "_line")
    whole = F.col("from_year").isNotNull() & F.col("from_class").isNotNull() & F.col("to_year").isNotNull()
    allowed = (m.where(whole).join(closed, F.col("from_year") == F.col("year"), "left_anti").join(closed, F.col("to_year") == F.col("year"), "left_anti"))
    first_source = allowed.groupBy("from_year", "from_class").agg(F.min(target).alias("_own"))
    m = (m.join(first_source, ["from_year", "from_class"], "left")
         .join(closed.withColumnRenamed("year", "from_year").withColumn("_from_closed", F.lit(True)), "from_year", "left")
         .join(closed.withColumnRenamed("year", "to_year").withColumn("_to_closed", F.lit(True)), "to_year", "left")
         .withColumn("_pre", F.when(~whole, F.lit("missing_parameters"))
                     .when(F.coalesce("_from_closed", "_to_closed").isNotNull(), F.lit("closed_year")).when(target != F.col("_own"), F.lit("duplicate_source"))).drop("_own", "_from_closed", "_to_closed"))
    m = cut_lineage(m)
    every, m = m, m.where(F.col("_pre").isNull())
    first_target = m.where(F.col("to_class").isNotNull()).groupBy("to_year", "to_class").agg(
        F.min(F.struct("from_year", "from_class")).alias("_first"))
    # Students of each mapping who already hold an enrollment in the target year.
    in_target_year = enr.select("student_master_id", F.col("academic_year_id").alias("to_year")).distinct()
    # Mappings and what is decided of them are as many as classes.
    moved = F.broadcast(m.where(F.col("to_class").isNotNull()))
    clashes = (active.join(moved, ["from_year", "from_class"])
               .join(by_key(in_target_year), ["student_master_id", "to_year"], "left_semi")
               .groupBy("from_year", "from_class").agg(F.count(F.lit(1)).alias("n_clash")))
    # Students active in several source classes that go to one year: later sources clash.
    moving = active.join(moved, ["from_year", "from_class"])
    earlier = moving.groupBy("student_master_id", "to_year").agg(F.min(F.struct("from_year", "from_class")).alias("_source"))
    twice = (moving.join(by_key(earlier), ["student_master_id", "to_year"]).where(F.struct("from_year", "from_class") != F.col("_source"))
             .select("from_year", "from_class").distinct().withColumn("_twice", F.lit(True)))

    j = (m.join(n_active, ["from_year", "from_class"], "left")
         .join(targets.withColumn("_exists", F.lit(True)), ["to_year", "to_class"], "left")
         .join(occupied.withColumn("_occupied", F.lit(True)), ["to_year", "to_class"], "left")
         .join(first_target, ["to_year", "to_class"], "left")
         .join(clashes, ["from_year", "from_class"], "left")
         .join(twice, ["from_year", "from_class"], "left"))
    reason = (F.when(F.coalesce(F.col("n_active"), F.lit(0)) == 0, F.lit("no_students"))
              .when(F.col("to_class").isNull(), F.lit(None))
              .when(F.col("_exists").isNull(), F.lit("target_missing"))
              .when(F.col("_occupied").isNotNull(), F.lit("already_promoted"))
              .when(F.struct("from_year", "from_class") != F.col("_first"), F.lit("duplicate_target"))
              .when(F.coalesce(F.col("n_clash"), F.lit(0)) > 0, F.lit("student_already_enrolled"))
              .when(F.col("_twice").isNotNull(), F.lit("duplicate_student")))
    columns = ["from_year", "from_class", "to_year", "to_class", REASON]
    decided = cut_lineage(j.withColumn(REASON, reason).select(*columns).unionByName(
        every.where(F.col("_pre").isNotNull()).withColumn(REASON, F.col("_pre")).select(*columns)))
    refused = decided.where(F.col(REASON).isNotNull())
    ok = decided.where(F.col(REASON).isNull())

    # New enrollments for accepted mappings with a target.
    starts = s.academic_years.select(F.col("academic_year_id").alias("to_year"), "start_date")
    moves = ok.where(F.col("to_class").isNotNull())
    new_rows = (active.join(F.broadcast(moves), ["from_year", "from_class"])
                .join(F.broadcast(starts), "to_year")
                .select("student_master_id", F.col("to_year").alias("academic_year_id"),
                        F.col("to_class").alias("class_id"), "roll_no",
                        F.col("start_date").alias("admission_date"), "user_id", F.lit("active").alias("status")))
    base = next_id_base(enr, "enrollment_id", ID_START["student_enrollments"])
    new_rows = assign_ids(new_rows, "enrollment_id", base, ["academic_year_id", "class_id", "roll_no"])

    # Old rows: every row of an accepted source class changes status.
    marks = ok.select(F.col("from_year").alias("academic_year_id"), F.col("from_class").alias("class_id"),
                      F.when(F.col("to_class").isNull(), "passed").otherwise("promoted").alias("_new_status"))
    old = (enr.join(F.broadcast(marks), ["academic_year_id", "class_id"], "left")
           .withColumn("status", F.coalesce(F.col("_new_status"), F.col("status"))).drop("_new_status"))
    return conform(old, "student_enrollments").unionByName(conform(new_rows, "student_enrollments")), refused


# ---------------------------------------------------------------------------------------------
# W11, W12

def _validated_pair(s: School, b: DataFrame, order: list[str],
                    sides: list[tuple[str, list[str], tuple[str, ...], Column | None]], enforce_closed: bool = False,
                    collation: str | None = None) -> DataFrame:
    """Validate one batch against several tables; ``reason`` is the first refusal of any side.
    Rows are taken in order, each into all its tables or into none.

    ``sides``: (table, batch columns for it, columns not to check, row filter or None).
    """
    out, looked = b.withColumn("_own", F.col("_pre")).withColumn("_outer", F.lit(None).cast("string")), [("", [])]
    for i, (table, cols, skip, cond) in enumerate(sides):
        part, tag = b if cond is None else b.where(cond), f"_{i}_"
        v, names = inspect_batch(s, table, part.select(*dict.fromkeys(["_row", *order, *cols])), order, skip,
                                 enforce_closed=enforce_closed, collation=collation, tag=tag)
        out = out.join(by_key(v.select("_row", *[c for c in v.columns if tag in c])), "_row", "left")
        looked.append((tag, names))
    return settle(out, looked, order, ["_row"]).drop("_pre")


def _missing(b: DataFrame, columns: list[str]) -> Column:
    """``missing:<column>`` for the first required column that is NULL, an empty string or 0."""
    def absent(c: str) -> Column:
        kind = b.schema[c].dataType.simpleString()
        empty = F.col(c) == F.lit("") if kind == "string" else F.col(c) == F.lit(0) if kind in ("int", "bigint", "smallint") else F.lit(False)
        return F.coalesce(F.col(c).isNull() | empty, F.lit(True))

    return reduce(lambda e, c: e.when(absent(c), F.lit(f"missing:{c}")), columns[1:], F.when(absent(columns[0]), F.lit(f"missing:{columns[0]}")))


ADMIT_REQUIRED = ["reg_no", "fname", "gender", "roll_no", "class_id", "academic_year_id", "admission_date"]


def admit_students(s: School, batch: DataFrame, order_by: list[str], enforce_closed: bool = False,
                   collation: str | None = None) -> tuple[School, DataFrame, DataFrame]:
    """Batch (reg_no, fname, gender, roll_no, class_id, academic_year_id, admission_date).

    A student row and its enrollment are accepted together or refused together, in order:
    a refused row holds neither its number nor its place.  ``enforce_closed`` refuses
    rows of closed years; ``collation`` compares registration numbers.
    Returns (new school, accepted rows with both new ids, rejected rows with a reason).
    """
    b = cut_lineage(batch.select(*ADMIT_REQUIRED)).withColumn("_row", F.monotonically_increasing_id())
    pre = _missing(b, ADMIT_REQUIRED)
    b = b.withColumn("_pre", pre)
    order = list(dict.fromkeys([*order_by, "_row"]))
    checked = cut_lineage(_validated_pair(s, b, order, [
        ("student_master", ["reg_no", "fname", "gender"], (), None),
        ("student_enrollments", ["class_id", "academic_year_id", "roll_no", "admission_date"],
         ("student_master_id",), None),
    ], enforce_closed, collation))
    ok = checked.where(F.col(REASON).isNull()).drop(REASON)
    rejected = checked.where(F.col(REASON).isNotNull()).drop("_row")
    sid = next_id_base(s.student_master, "student_master_id", ID_START["student_master"])
    eid = next_id_base(s.student_enrollments, "enrollment_id", ID_START["student_enrollments"])
    with_sid = assign_ids(ok, "student_master_id", sid, order)
    accepted = cut_lineage(assign_ids(with_sid, "enrollment_id", eid, order)).drop("_row")
    students = accepted.select("student_master_id", "reg_no", "fname", "gender")
    enrollments = accepted.select("enrollment_id", "student_master_id", "academic_year_id", "class_id", "roll_no",
                                  "admission_date", F.lit("active").alias("status"))
    s2 = s.replace(student_master=s.student_master.unionByName(conform(students, "student_master")),
                   student_enrollments=s.student_enrollments.unionByName(
                       conform(enrollments, "student_enrollments")))
    return s2, accepted, rejected


REGISTER_REQUIRED = ["fname", "reg_no", "role", "date"]


def register_people(s: School, batch: DataFrame, order_by: list[str], enforce_closed: bool = False,
                    collation: str | None = None) -> tuple[School, DataFrame, DataFrame]:
    """Batch (fname, role, date, salary, roll_no, reg_no, class_id); username = reg_no.

    Each row creates a user and, by role, an employee (joining_date = date) or a
    student with an enrollment in the class's year (admission_date = date).
    All tables of a row are accepted or refused together, in order.  ``enforce_closed`` refuses
    rows of closed years; ``collation`` compares user names and registration numbers.
    """
    b = cut_lineage(batch.select("fname", "role", "date", "salary", "roll_no", "reg_no", "class_id"))
    cls = s.classes.select("class_id", "academic_year_id")
    b = (b.join(cls, "class_id", "left")
         .withColumn("_row", F.monotonically_increasing_id())
         .withColumn("username", F.col("reg_no"))
         .withColumn("joining_date", F.col("date")).withColumn("admission_date", F.col("date")))
    pre = _missing(b, REGISTER_REQUIRED)
    pre = pre.when((F.col("role") == "student") & F.col("class_id").isNotNull()
                   & F.col("academic_year_id").isNull(), F.lit("missing_parent:class_id"))
    b = b.withColumn("_pre", pre)
    order = list(dict.fromkeys([*order_by, "_row"]))
    is_student = F.col("role") == "student"
    checked = cut_lineage(_validated_pair(s, b, order, [
        ("users", ["username", "role"], (), None),
        ("employees", ["reg_no", "fname", "joining_date", "salary"], ("user_id",), ~is_student),
        ("student_master", ["reg_no", "fname"], (), is_student),
        ("student_enrollments", ["class_id", "academic_year_id", "roll_no", "admission_date"],
         ("student_master_id",), is_student),
    ], enforce_closed, collation))
    ok = checked.where(F.col(REASON).isNull()).drop(REASON)
    rejected = checked.where(F.col(REASON).isNotNull()).drop("_row")

    with_uid = cut_lineage(assign_ids(ok, "user_id", next_id_base(s.users, "user_id", ID_START["users"]), order))
    emp = assign_ids(with_uid.where(~is_student), "employee_id",
                     next_id_base(s.employees, "employee_id", ID_START["employees"]), order)
    stu = assign_ids(with_uid.where(is_student), "student_master_id",
                     next_id_base(s.student_master, "student_master_id", ID_START["student_master"]), order)
    stu = assign_ids(stu, "enrollment_id",
                     next_id_base(s.student_enrollments, "enrollment_id", ID_START["student_enrollments"]), order)
    emp, stu = cut_lineage(emp), cut_lineage(stu)
    users = with_uid.select("user_id", "username", "role", F.lit("active").alias("status"))
    s2 = s.replace(
        users=s.users.unionByName(conform(users.withColumn("created_at", F.lit(None)), "users")),
        employees=s.employees.unionByName(conform(emp, "employees")),
        student_master=s.student_master.unionByName(conform(stu, "student_master")),
        student_enrollments=s.student_enrollments.unionByName(
            conform(stu.withColumn("status", F.lit("active")), "student_enrollments")))
    accepted = (emp.select("_row", "user_id", "username", "role", "employee_id",
                           F.lit(None).cast("long").alias("student_master_id"),
                           F.lit(None).cast("long").alias("enrollment_id"))
                .unionByName(stu.select("_row", "user_id", "username", "role",
                                        F.lit(None).cast("long").alias("employee_id"), "student_master_id",
                                        "enrollment_id"))
                .drop("_row"))
    return s2, accepted, rejected


# ---------------------------------------------------------------------------------------------
# W13

# Parents before children: the order in which deletions propagate.
TOPOLOGICAL = ["users", "academic_years", "employees", "student_master", "classes", "student_enrollments",
               "subjects", "exams", "marks", "attendance_students", "fee_structures",
               "student_fee_assignments", "fee_payments"]


def _side(table: str, keys: DataFrame) -> DataFrame:
    return keys if table in BY_YEAR else by_key(keys)


def delete_cascade(s: School, table: str, keys: DataFrame) -> School:
    """Delete the keyed rows of ``table`` and follow the declared foreign keys:
    ``cascade`` deletes referencing rows (transitively), ``set null`` clears the reference."""
    deleted: dict[str, DataFrame] = {table: keys.select(PRIMARY_KEYS[table]).distinct()}
    nulled: dict[str, list[tuple[str, DataFrame]]] = {}
    for child in TOPOLOGICAL:
        pk = PRIMARY_KEYS[child]
        parts = [deleted[child]] if child in deleted else []
        for c, col, parent, ppk, rule in FOREIGN_KEYS:
            if c != child or parent not in deleted:
                continue
            gone = _side(parent, deleted[parent].select(F.col(PRIMARY_KEYS[parent]).alias(col)))
            if rule == "cascade":
                parts.append(s.table(child).join(gone, col, "left_semi").select(pk))
            else:
                nulled.setdefault(child, []).append((col, gone))
        if parts:
            # Checkpointed so every later table reuses the key set instead of recomputing the chain.
            deleted[child] = cut_lineage(reduce(DataFrame.unionByName, parts).distinct())
    out = {}
    for name in SCHEMAS:
        df = s.table(name)
        if name in deleted:
            df = df.join(_side(name, deleted[name]), PRIMARY_KEYS[name], "left_anti")
        for col, gone in nulled.get(name, []):
            flag = f"_gone_{col}"
            lost = gone.withColumn(flag, F.lit(True)).withColumn("_spread", F.lit(0).cast("long"))
            df = (spread_nulls(df, [col], [PRIMARY_KEYS[name]]).join(lost, [col, "_spread"], "left").drop("_spread")
                  .withColumn(col, F.when(F.col(flag).isNull(), F.col(col))).drop(flag))
        out[name] = conform(df, name)
    return School(**out)

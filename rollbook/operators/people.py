"""Admin, enrollment, subject and user reports.

Lookups that the reference does for one id at a time take an optional
``keys`` DataFrame (semi-join) and otherwise cover the whole table.  For
user-keyed reports "the whole table" means every row reachable through a
user id (a NULL user id can never be looked up).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.exprs import full_name, full_name_strict
from rollbook.operators.common import classes_dim, employees_dim, with_student, years_dim
from rollbook.plans.dims import by_key, in_active_year, restrict
from rollbook.sources.store import School


def _year(df: DataFrame, year: int | None) -> DataFrame:
    return df if year is None else df.where(F.col("academic_year_id") == F.lit(year))


def _by_user(df: DataFrame, keys: DataFrame | None) -> DataFrame:
    return restrict(df.where(F.col("user_id").isNotNull()), keys, "user_id")


def _class_sizes(s: School) -> DataFrame:
    return s.student_enrollments.groupBy("class_id").agg(F.count(F.lit(1)).alias("total_students"))


def students_by_year(s: School, year: int | None = None, match_year: bool = True) -> DataFrame:
    """Roster of a year.  ``match_year`` joins the class on (class_id, year) so an
    enrollment pointing at another year's class drops out; otherwise on class_id only,
    with the status column (the shadowed variant)."""
    enr = _year(s.student_enrollments, year)
    x = with_student(enr.select("enrollment_id", "student_master_id", "class_id", "academic_year_id", "roll_no",
                                "status"), s, "reg_no", "fname", "lname")
    on = ["class_id", "academic_year_id"] if match_year else ["class_id"]
    cls = s.classes.select("class_id", "class_level", "division",
                                 *(["academic_year_id"] if match_year else []))
    cols = ["academic_year_id", "enrollment_id", "class_id", "roll_no"] + ([] if match_year else ["status"])
    return (x.join(F.broadcast(cls), on)
            .select(*cols, "reg_no", full_name("fname", "lname").alias("name"), "class_level", "division")
            .orderBy("academic_year_id", "class_level", "division", "roll_no", "enrollment_id"))


def classes_by_year(s: School, year: int | None = None) -> DataFrame:
    """Classes of a year (or every year) by level and division."""
    return (_year(s.classes, year).select("academic_year_id", "class_id", "class_level", "division")
            .orderBy("academic_year_id", "class_level", "division"))


def _classes_with_teacher(s: School, cls: DataFrame) -> DataFrame:
    teacher = employees_dim(s, "fname", "lname").withColumnRenamed("employee_id", "class_teacher_id")
    return (cls.join(teacher, "class_teacher_id", "left")
            .join(_class_sizes(s), "class_id", "left")
            .withColumn("total_students", F.coalesce("total_students", F.lit(0)))
            .withColumn("class_teacher", F.when(F.col("class_teacher_id").isNull(), F.lit(None))
                        .otherwise(full_name("fname", "lname"))))


def classes_with_teacher(s: School, year: int | None = None) -> DataFrame:
    """Classes of a year with class teacher name (NULL if unset) and student count."""
    x = _classes_with_teacher(s, _year(s.classes, year))
    return (x.select("academic_year_id", "class_id", "class_level", "division", "class_teacher_id",
                     "class_teacher", "total_students")
            .orderBy("academic_year_id", "class_level", "division"))


def class_profile(s: School, keys: DataFrame | None = None) -> DataFrame:
    """One class (or each) with teacher and student count."""
    x = _classes_with_teacher(s, restrict(s.classes, keys, "class_id"))
    return x.select("class_id", "class_level", "division", "class_teacher_id", "academic_year_id",
                    full_name("fname", "lname").alias("class_teacher"), "total_students")


def count_by_class_division(s: School, year: int | None = None) -> DataFrame:
    """Students per level × division of a year (0 kept)."""
    x = _year(s.classes, year).join(_class_sizes(s), "class_id", "left")
    return (x.groupBy("academic_year_id", "class_level", "division")
            .agg(F.coalesce(F.sum("total_students"), F.lit(0)).cast("long").alias("total_students")))


def students_by_class(s: School, class_id: int | None = None) -> DataFrame:
    """Roster of a class in any year, with status, by roll number."""
    enr = s.student_enrollments
    if class_id is not None:
        enr = enr.where(F.col("class_id") == F.lit(class_id))
    x = with_student(enr.select("class_id", "enrollment_id", "student_master_id", "roll_no", "status"), s,
                     "reg_no", "fname", "lname")
    return (x.select("class_id", "enrollment_id", "roll_no", "reg_no", full_name("fname", "lname").alias("name"),
                     "status")
            .orderBy("class_id", "roll_no"))


def admin_dashboard(s: School, year: int | None = None) -> DataFrame:
    """Per year: classes, enrollments, teachers (all users with role teacher), subjects."""
    def per_year(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("academic_year_id").agg(F.count(F.lit(1)).alias(name))

    teachers = s.users.where(F.col("role") == "teacher").agg(F.count(F.lit(1)).alias("n")).scalar()
    x = (_year(s.academic_years, year).select("academic_year_id")
         .join(per_year(s.classes, "total_classes"), "academic_year_id", "left")
         .join(per_year(s.student_enrollments, "total_students"), "academic_year_id", "left")
         .join(per_year(s.subjects, "total_subjects"), "academic_year_id", "left"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return x.select("academic_year_id", z("total_classes"), z("total_students"),
                    teachers.alias("total_teachers"), z("total_subjects"))


def academic_years(s: School) -> DataFrame:
    """All years, newest first."""
    return s.academic_years.orderBy(F.desc("start_date"), F.desc("academic_year_id"))


def staff_by_role(s: School, role: str | None = None) -> DataFrame:
    """Teachers or accountants (or both) with salary and login status."""
    roles = ["teacher", "accountant"] if role is None else [role]
    u = s.users.where(F.col("role").isin(roles)).select("user_id", "role", "status")
    return (s.employees.join(u, "user_id")
            .select("employee_id", "fname", "lname", "salary", "status", "user_id", "role"))


def employee_profile(s: School, keys: DataFrame | None = None) -> DataFrame:
    """Employee with login name, by user id."""
    e = restrict(s.employees, keys, "user_id")
    return (e.join(by_key(s.users.select("user_id", "username")), "user_id")
            .select("user_id", "employee_id", "fname", "lname", "reg_no", "gender", "mobile", "email",
                    "joining_date", "salary", "username"))


def student_profile(s: School, keys: DataFrame | None = None) -> DataFrame:
    """Active-year profile of a student login (or of every one)."""
    enr = _by_user(in_active_year(s.student_enrollments, s.academic_years), keys)
    x = with_student(enr.select("user_id", "student_master_id", "roll_no", "admission_date", "class_id",
                                "academic_year_id"), s,
                     "reg_no", "fname", "lname", "mother_name", "gender", "dob", "email", "mobile", "address")
    return (x.join(classes_dim(s, "class_level", "division"), "class_id")
            .join(years_dim(s, "year_name"), "academic_year_id")
            .select("user_id", "student_master_id", "reg_no", "fname", "lname", "mother_name", "gender", "dob",
                    "email", "mobile", "address", "roll_no", "admission_date", "class_level", "division",
                    "year_name"))


def current_enrollment(s: School, keys: DataFrame | None = None) -> DataFrame:
    """Active-year enrollment snapshot with class teacher, per student login."""
    enr = _by_user(in_active_year(s.student_enrollments, s.academic_years), keys)
    teacher = employees_dim(s, "fname", "lname").withColumnRenamed("employee_id", "class_teacher_id")
    x = (enr.join(classes_dim(s, "class_level", "division", "class_teacher_id"), "class_id")
         .join(years_dim(s, "year_name"), "academic_year_id")
         .join(teacher, "class_teacher_id", "left"))
    return x.select("user_id", "enrollment_id", "student_master_id", "roll_no", "admission_date",
                    "academic_year_id", F.col("year_name").alias("academic_year"), "class_id", "class_level",
                    "division", full_name("fname", "lname").alias("class_teacher"))


def enrollment_history(s: School, keys: DataFrame | None = None) -> DataFrame:
    """Every year's enrollment of a student login, newest first."""
    enr = _by_user(s.student_enrollments, keys)
    x = (enr.join(classes_dim(s, "class_level", "division"), "class_id")
         .join(years_dim(s, "year_name", "is_active", "start_date", "end_date"), "academic_year_id"))
    return (x.select("user_id", "enrollment_id", "roll_no", "class_level", "division", "year_name", "is_active",
                     "start_date", "end_date")
            .orderBy("user_id", F.desc("start_date"), "enrollment_id"))


def subjects_of_class(s: School, class_id: int | None = None, form: str = "teacher") -> DataFrame:
    """Subjects of a class: with teacher name ('teacher'), all columns ('all'), or id+name ('dropdown')."""
    sub = s.subjects if class_id is None else s.subjects.where(F.col("class_id") == F.lit(class_id))
    if form == "all":
        return sub.orderBy("class_id", "subject_id")
    if form == "dropdown":
        return sub.select("class_id", "subject_id", "subject_name").orderBy("class_id", "subject_id")
    teacher = employees_dim(s, "fname", "lname").withColumnRenamed("employee_id", "teacher_id")
    return (sub.join(teacher, "teacher_id")
            .select("class_id", "subject_id", "subject_name", "teacher_id",
                    full_name("fname", "lname").alias("teacher"))
            .orderBy("class_id", "subject_id"))


def subject_details(s: School, keys: DataFrame | None = None) -> DataFrame:
    """Subject with class level/division and teacher (NULL-propagating name)."""
    sub = restrict(s.subjects, keys, "subject_id")
    teacher = employees_dim(s, "fname", "lname").withColumnRenamed("employee_id", "teacher_id")
    return (sub.join(classes_dim(s, "class_level", "division"), "class_id").join(teacher, "teacher_id")
            .select("subject_id", "subject_name", "class_level", "division",
                    full_name_strict("fname", "lname").alias("teacher")))


def subject_by_id(s: School, keys: DataFrame | None = None) -> DataFrame:
    """R42 (id form): subject id, name, class and teacher ids."""
    return restrict(s.subjects, keys, "subject_id").select("subject_id", "subject_name", "class_id", "teacher_id")


def subjects_of_teacher(s: School, keys: DataFrame | None = None) -> DataFrame:
    """All subject columns of a teacher (or of every teacher)."""
    return restrict(s.subjects, keys, "teacher_id").orderBy("teacher_id", "subject_id")


def subjects_of_student(s: School, keys: DataFrame | None = None) -> DataFrame:
    """A student login's active-year class subjects with teacher names."""
    enr = _by_user(in_active_year(s.student_enrollments, s.academic_years), keys).select(
        "user_id", "enrollment_id", "class_id")
    teacher = employees_dim(s, "fname", "lname").withColumnRenamed("employee_id", "teacher_id")
    sub = s.subjects.select("class_id", "subject_id", "subject_name", "teacher_id")
    return (enr.join(sub, "class_id").join(teacher, "teacher_id")
            .select("user_id", "enrollment_id", "subject_id", "subject_name",
                    full_name_strict("fname", "lname").alias("teacher_name")))


def subject_count_per_class(s: School) -> DataFrame:
    """Subjects per class, classes without subjects kept with 0."""
    n = s.subjects.groupBy("class_id").agg(F.count(F.lit(1)).alias("total_subjects"))
    return (s.classes.join(n, "class_id", "left")
            .select("class_id", "class_level", "division",
                    F.coalesce("total_subjects", F.lit(0)).alias("total_subjects")))


def subject_count_per_teacher(s: School) -> DataFrame:
    """Subjects per employee (0 kept); keyed by employee, name is NULL-propagating."""
    n = s.subjects.groupBy("teacher_id").agg(F.count(F.lit(1)).alias("total_subjects"))
    return (s.employees.join(n, s.employees["employee_id"] == n["teacher_id"], "left")
            .select("employee_id", full_name_strict("fname", "lname").alias("teacher_name"),
                    F.coalesce("total_subjects", F.lit(0)).alias("total_subjects")))


def unassigned_subjects(s: School) -> DataFrame:
    """Subjects without a teacher (always empty while teacher_id is NOT NULL)."""
    return s.subjects.where(F.col("teacher_id").isNull())


def search(df: DataFrame, col: str, keyword: str, accent_insensitive: bool = False) -> DataFrame:
    """Rows whose ``col`` contains ``keyword`` case-insensitively ('%' and '_' are literal)."""
    if accent_insensitive:
        quoted = keyword.replace("\\", "\\\\").replace("'", "\\'")
        return df.where(F.expr(f"contains(`{col}` COLLATE UNICODE_CI_AI, '{quoted}')"))
    return df.where(F.lower(F.col(col)).contains(keyword.lower()))


def _grams(text: F.Column, size: int) -> F.Column:
    """The different substrings of ``size`` characters."""
    return F.array_distinct(F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))
                            .otherwise(F.array().cast("array<string>")))


def search_keywords(df: DataFrame, col: str, keywords: DataFrame) -> DataFrame:
    """R48 for a table of keywords (``keyword``): each different keyword with the rows of ``df`` whose
    ``col`` contains it case-insensitively.  The empty keyword is in every text; a NULL matches nothing.

    Postings of the three-character substrings that occur in keywords (of shorter ones for
    shorter keywords) are joined with each keyword's rarest, then checked exactly.  No row
    meets a keyword with which it shares no substring.
    """
    words = keywords.select("keyword").where("keyword is not null").distinct().withColumn("_word", F.lower("keyword"))
    size = F.least(F.length("_word"), F.lit(3))
    grams = reduce(lambda e, n: e.when(size == n, _grams(F.col("_word"), n)), (1, 2, 3), F.when(size == 0, F.array(F.lit(""))))
    wanted = words.select("keyword", "_word", F.explode(grams).alias("_gram"))
    text = F.lower(F.col(col))
    every = F.concat(F.array(F.lit("")), *[_grams(F.col("_text"), n) for n in (1, 2, 3)])
    rows = df.where(F.col(col).isNotNull()).select(F.struct(*df.columns).alias("_row"), text.alias("_text"))
    postings = rows.select("_row", "_text", F.explode(every).alias("_gram")).join(wanted.select("_gram").distinct(), "_gram", "left_semi")
    common = postings.groupBy("_gram").agg(F.count("*").alias("_n"))
    # A substring that no row has makes the keyword find nothing.
    rarest = wanted.join(common, "_gram", "left").groupBy("keyword", "_word").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_best"))
    asked = rarest.where("_best.n > 0").select("keyword", "_word", F.col("_best._gram").alias("_gram"))
    return postings.join(asked, "_gram").where(F.contains("_text", "_word")).select("keyword", "_row.*")


def search_subjects(s: School, keyword: str) -> DataFrame:
    return search(s.subjects, "subject_name", keyword)


def search_users(s: School, keyword: str) -> DataFrame:
    return search(s.users, "username", keyword).select("user_id", "username", "role")


def users(s: School, role: str | None = None, status: str | None = None,
          keys: DataFrame | None = None) -> DataFrame:
    """User list (never a password), optionally by role, status or ids."""
    u = restrict(s.users, keys, "user_id")
    if role is not None:
        u = u.where(F.col("role") == F.lit(role))
    if status is not None:
        u = u.where(F.col("status") == F.lit(status))
    return u.select("user_id", "username", "role", "status")


def user_count_by_role(s: School) -> DataFrame:
    """Role → number of users."""
    return s.users.groupBy("role").agg(F.count(F.lit(1)).alias("total"))


def recent_users(s: School, n: int = 10) -> DataFrame:
    """The n most recently created users (ties: higher id first)."""
    return (s.users.orderBy(F.desc("created_at"), F.desc("user_id")).limit(n)
            .select("user_id", "username", "role"))


def users_exist(s: School, wanted: DataFrame, collation: str | None = None) -> DataFrame:
    """For each wanted username, how many users carry it (0 when none), compared under ``collation``."""
    key = F.collate("username", collation) if collation else F.col("username")
    n = s.users.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("count"))
    return (wanted.select("username").distinct().withColumn("_key", key).join(n, "_key", "left")
            .select("username", F.coalesce("count", F.lit(0)).alias("count")))

"""Audits of the declared rules (Q1–Q5).

MySQL enforced keys, references and allowed values; Parquet does not, so
they become table checks.  Each check first reduces the checked table to
its distinct keys with counts (partial aggregation, skew-safe) and only
then joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.plans.dims import by_key
from rollbook.sources.schema import (
    ALLOWED_VALUES, FOREIGN_KEYS, MAX_LENGTHS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS, not_null_columns)
from rollbook.sources.store import School


def audit_unique(df: DataFrame, cols: list[str] | tuple[str, ...], collation: str | None = None) -> DataFrame:
    """Q1: key values held by more than one row (rows with a NULL in the key never clash).

    Under a ``collation`` (e.g. ``UNICODE_CI_AI``) strings that are equal there are one value, shown by the least of them.
    """
    keyed = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    if collation:
        text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
        keyed = keyed.select(*cols, *[(F.collate(F.col(c), collation) if c in text else F.col(c)).alias(f"_{c}") for c in cols])
        same = keyed.groupBy(*[f"_{c}" for c in cols]).agg(F.min(F.struct(*cols)).alias("_least"), F.count(F.lit(1)).alias("n"))
        return same.where(F.col("n") > 1).select(*[F.col(f"_least.{c}").alias(c) for c in cols], "n")
    return keyed.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def audit_all_unique(s: School) -> DataFrame:
    """Q1 over every primary and declared unique key: table, columns, key text, rows.

    One scan of each table, whose rows are unpivoted into one row for each key, and one grouped
    count over all tables.  As every value of every key is a group, a group is no more than the key's
    number and one text; names are looked up for what is left.
    """
    parts, names = [], []
    for table in SCHEMAS:
        keys = [(PRIMARY_KEYS[table],)] + list(UNIQUE_KEYS.get(table, []))
        unpivoted = F.array(*[F.struct(F.lit(len(names) + i).alias("rule"), _key_text(table, cols).alias("value")) for i, cols in enumerate(keys)])
        parts.append(s.table(table).select(F.inline(unpivoted)).where("value is not null"))
        names += [F.struct(F.lit(table).alias("table_name"), F.lit(",".join(cols)).alias("columns")) for cols in keys]
    counts = reduce(DataFrame.unionByName, parts).groupBy("rule", "value").agg(F.count(F.lit(1)).alias("n"))
    text = F.substring("value", F.locate(":", "value") + 1, F.length("value"))
    return counts.where(F.col("n") > 1).select(F.get(F.array(*names), F.col("rule")).alias("name"), text.alias("key"), "n").select("name.*", "key", "n")


def _key_text(table: str, cols: tuple[str, ...]) -> F.Column:
    """A key's values joined by ``|`` behind a ``:``; NULL if one is NULL.  Where a value may hold a ``|``
    itself, the lengths of the values come first, so that different keys have different texts."""
    texts = [F.col(c).cast("string") for c in cols]
    told = len(cols) > 1 and any(SCHEMAS[table][c].dataType.typeName() == "string" for c in cols)
    lengths = F.concat_ws(",", *[F.length(t).cast("string") for t in texts]) if told else F.lit("")
    joined = [x for t in texts for x in (F.lit("|"), t)][1:]
    return F.concat(lengths, F.lit(":"), *joined)


def audit_foreign_key(child: DataFrame, col: str, parent: DataFrame, pk: str) -> DataFrame:
    """Q2: non-NULL child values without a parent row, with the number of child rows."""
    values = child.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    parents = parent.select(F.col(pk).alias(col))
    return values.join(by_key(parents), col, "left_anti")


def audit_all_foreign_keys(s: School) -> DataFrame:
    """Q2 over every declared foreign key: child table/column, parent table, value, rows.

    One scan of each table, whose rows are unpivoted into their own id, as a parent, and their
    references, and one aggregate over (parent table, value): whether a parent row has the
    value, and how many rows refer to it by each key.
    """
    # The references to each parent table: a group needs as many counts as the most of them.
    children = {table: [(child, col) for child, col, parent, _, _ in FOREIGN_KEYS if parent == table] for table in SCHEMAS}
    parents = [table for table in SCHEMAS if children[table]]
    role = lambda parent, key, c: F.struct(F.lit(parents.index(parent)).alias("parent"), F.lit(key).alias("key"), F.col(c).cast("long").alias("value"))
    parts = []
    for table in SCHEMAS:
        roles = [role(parent, key, col) for parent in parents for key, (child, col) in enumerate(children[parent]) if child == table]
        roles += [role(table, -1, PRIMARY_KEYS[table])] if table in parents else []
        if roles:
            parts.append(s.table(table).select(F.inline(F.array(*roles))).where("value is not null"))
    values = reduce(DataFrame.unionByName, parts).groupBy("parent", "value").agg(
        F.max(F.col("key") == -1).alias("known"), *[F.count_if(F.col("key") == n).alias(f"n{n}") for n in range(max(map(len, children.values())))])
    told = F.array(*[F.array(*[F.struct(F.lit(child).alias("child_table"), F.lit(col).alias("child_column"), F.lit(parent).alias("parent_table"), F.col(f"n{n}").alias("n"))
                               for n, (child, col) in enumerate(children[parent])]) for parent in parents])
    return values.where("not known").select("value", F.inline(F.get(told, F.col("parent")))).where("n > 0").select("child_table", "child_column", "parent_table", "value", "n")


def value_rules(table: str) -> list[tuple[str, str, F.Column]]:
    """(rule, column, violation predicate) for NOT NULL, allowed values and lengths of ``table``."""
    rules = [("not_null", c, F.col(c).isNull()) for c in not_null_columns(table)]
    for c, allowed in ALLOWED_VALUES.get(table, {}).items():
        rules.append(("allowed", c, F.col(c).isNotNull() & ~F.col(c).isin(list(allowed))))
    for c, n in MAX_LENGTHS.get(table, {}).items():
        rules.append(("max_length", c, F.length(c) > n))
    for c, (p, sc) in decimal_columns(table).items():
        rules.append(("range", c, F.abs(F.col(c)) >= F.lit(10 ** (p - sc))))
    return rules


def decimal_columns(table: str) -> dict[str, tuple[int, int]]:
    """Declared DECIMAL(p, s) columns of ``table``: a value must stay below 10^(p-s) in magnitude."""
    return {f.name: (f.dataType.precision, f.dataType.scale) for f in SCHEMAS[table].fields
            if f.dataType.typeName() == "decimal"}


def audit_values(df: DataFrame, table: str) -> DataFrame:
    """Q3: violations per rule of one table, all rules counted in one pass over the table."""
    rules = value_rules(table)
    wide = df.agg(*[F.count_if(pred).alias(f"r{i}") for i, (_r, _c, pred) in enumerate(rules)])
    long = wide.unpivot([], [f"r{i}" for i in range(len(rules))], "rule_ix", "violations")
    labels = [F.lit(f"r{i}") for i in range(len(rules))]
    names = F.create_map(*[x for i, (r, c, _p) in enumerate(rules)
                           for x in (labels[i], F.lit(f"{r}:{c}"))])
    return long.select(F.lit(table).alias("table_name"),
                       F.element_at(names, F.col("rule_ix")).alias("rule"),
                       F.col("violations").cast("long").alias("violations"))


def audit_all_values(s: School) -> DataFrame:
    return reduce(DataFrame.unionByName, [audit_values(s.table(t), t) for t in SCHEMAS if value_rules(t)])


def audit_closed_year(s: School) -> DataFrame:
    """Q4: what a closed year forbids — two enrollments of a student in one year (double
    promotion), attendance or admissions dated after a closed year's end, and marks of a
    closed year's enrollment in an exam of a later year."""
    closed = s.academic_years.where(F.col("is_closed").eqNullSafe(True)).select("academic_year_id", "end_date")
    dup = (audit_unique(s.student_enrollments, ["student_master_id", "academic_year_id"])
           .select(F.lit("duplicate_enrollment").alias("rule"), F.col("student_master_id").alias("key"),
                   "academic_year_id", F.lit(None).cast("date").alias("dated")))
    enr = s.student_enrollments.select("enrollment_id", "academic_year_id", "admission_date")
    late_adm = (enr.join(closed, "academic_year_id").where(F.col("admission_date") > F.col("end_date"))
                .select(F.lit("admission_after_close").alias("rule"), F.col("enrollment_id").alias("key"),
                        "academic_year_id", F.col("admission_date").alias("dated")))
    closed_enr = enr.join(closed, "academic_year_id").select("enrollment_id", "academic_year_id", "end_date")
    late_att = (s.attendance_students.join(by_key(closed_enr), "enrollment_id")
                .where(F.col("attendance_date") > F.col("end_date"))
                .select(F.lit("attendance_after_close").alias("rule"), F.col("attendance_id").alias("key"),
                        "academic_year_id", F.col("attendance_date").alias("dated")))
    # A mark of a closed year's enrollment must be of an exam of that year.
    exams = s.exams.select("exam_id", F.col("academic_year_id").alias("exam_year"))
    marks = (s.marks.select("mark_id", "enrollment_id", "exam_id").join(by_key(closed_enr), "enrollment_id").join(exams, "exam_id")
             .where(F.col("exam_year") > F.col("academic_year_id"))
             .select(F.lit("mark_after_close").alias("rule"), F.col("mark_id").alias("key"),
                     "academic_year_id", F.lit(None).cast("date").alias("dated")))
    return reduce(DataFrame.unionByName, [dup, late_adm, late_att, marks])


def audit_enrollment_class_year(s: School) -> DataFrame:
    """Q5: enrollments whose class belongs to another academic year."""
    cls = s.classes.select("class_id", F.col("academic_year_id").alias("class_year_id"))
    return (s.student_enrollments.select("enrollment_id", "class_id", "academic_year_id")
            .join(cls, "class_id").where(F.col("academic_year_id") != F.col("class_year_id")))

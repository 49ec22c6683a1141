"""Column expressions shared by the operators.

All of them are built-in Catalyst expressions (whole-stage codegen), never
Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full_name(fname, lname) -> Column:
    """``fname || ' ' || coalesce(lname, '')`` — keeps the trailing space for a NULL lname."""
    return F.concat(_c(fname), F.lit(" "), F.coalesce(_c(lname), F.lit("")))


def full_name_strict(fname, lname) -> Column:
    """``fname || ' ' || lname`` — NULL when lname is NULL (string concat is NULL-propagating)."""
    return F.concat(_c(fname), F.lit(" "), _c(lname))


# Fixed grade bands: lower bound of the percentage (inclusive) and letter.
GRADE_BANDS = [(90, "A+"), (80, "A"), (70, "B"), (60, "C"), (40, "D")]
FAIL_GRADE = "F"


def grade(obtained, max_marks) -> Column:
    """Letter grade of ``obtained / max_marks * 100`` compared without division.

    A NULL mark counts as 0 (grade F); a missing or non-positive maximum has no grade.
    """
    o = F.coalesce(_c(obtained), F.lit(0))
    m = _c(max_marks)
    expr = F.when(m.isNull() | (m <= 0), F.lit(None).cast("string"))
    for bound, letter in GRADE_BANDS:
        expr = expr.when(o * 100 >= m * bound, letter)
    return expr.otherwise(FAIL_GRADE)


def percentage(obtained_sum, max_sum) -> Column:
    """``round(obtained / max * 100, 2)`` in decimal (half-up); NULL when max is 0 or NULL."""
    return F.round(F.try_divide(_c(obtained_sum) * 100, _c(max_sum)), 2)


def zero_if_null(x) -> Column:
    return F.coalesce(_c(x), F.lit(0))


def to_edge(df: DataFrame) -> DataFrame:
    """Result edge: decimals to double (computed exactly first), so results compare across engines."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)

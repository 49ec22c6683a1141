"""Set-based table changes, part 1.

A change takes the current table(s) and a DataFrame of changes and returns
new DataFrames; nothing is written in place.  Validation rejects rows with
a reason instead of failing the batch: a row that MySQL would refuse
(missing value, bad enum member, duplicate key, missing parent) is
reported in ``rejected``; in-batch conflicts keep the first row by an
explicit order.

New ids continue after the current maximum: the accepted rows are sorted
globally by the caller's order, checkpointed (stable partitions), counted
per partition, and each row gets ``max + partition offset + position``.
No step moves the batch through one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.operators.acceptance import beaten
from rollbook.plans.dims import by_key, cut_lineage
from rollbook.sources.schema import (
    ALLOWED_VALUES, BY_YEAR, DEFAULTS, FOREIGN_KEYS, ID_START, MAX_LENGTHS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS,
    not_null_columns)
from rollbook.sources.store import School, conform

REASON = "reason"


# ---------------------------------------------------------------------------------------------
# ids

def next_id_base(existing: DataFrame, id_col: str, start: int) -> Column:
    """Scalar column: the largest existing id, or ``start - 1`` for an empty table."""
    return F.coalesce(existing.agg(F.max(id_col).alias("m")).scalar(), F.lit(start - 1).cast("long"))


def assign_ids(df: DataFrame, id_col: str, base: Column, order_by: list[str],
               presorted: bool = False) -> DataFrame:
    """Number the rows of ``df`` as base+1, base+2, … in ``order_by`` order (a total order).

    Distributed: a global sort (range partitions), a reliable checkpoint so the
    partitions are fixed, then per-partition counts (one row per partition) turned
    into offsets.  Deterministic on recomputation.  ``presorted`` means ``df`` is
    already a row filter of a globally sorted, checkpointed frame (no second sort).
    """
    ordered = df if presorted else cut_lineage(df.orderBy(*order_by))
    pos = (ordered.withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    counts = pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: bounded by the partition count, safe in one window and broadcast.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (pos.join(F.broadcast(offsets), "_pid")
            .withColumn(id_col, base + F.col("_off") + within + 1)
            .drop("_pid", "_mid", "_off"))


# ---------------------------------------------------------------------------------------------
# Validated append

def _first_reason(checks: list[tuple[Column, str]]) -> Column:
    expr = None
    for cond, reason in checks:
        expr = F.when(cond, F.lit(reason)) if expr is None else expr.when(cond, F.lit(reason))
    return expr if expr is not None else F.lit(None).cast("string")


def spread_nulls(df: DataFrame, key: list[str], row: list[str]) -> DataFrame:
    """``df`` with ``_spread``: 0 where the key is whole, else a hash of the row.  Rows with a NULL in
    the key match nothing in a join; with this column in it they do not all meet in one task."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    return df.withColumn("_spread", F.when(whole, F.lit(0).cast("long")).otherwise(F.xxhash64(*row)))


def _flag_keys(df: DataFrame, key_sets: list[tuple[list[str], DataFrame, str]], row: list[str]) -> DataFrame:
    """For each (columns, bad key table, reason): rows whose key is in the bad table get the reason.

    The bad tables hold distinct keys only, so each is one row per key.
    """
    for i, (cols, bad, reason) in enumerate(key_sets):
        flag = f"_bad{i}"
        keys = bad.select(*cols).distinct().withColumn(flag, F.lit(True)).withColumn("_spread", F.lit(0).cast("long"))
        df = (spread_nulls(df, cols, row).join(keys, [*cols, "_spread"], "left").drop("_spread")
              .withColumn(REASON, F.when(F.col(REASON).isNull() & F.col(flag).isNotNull(), F.lit(reason))
                          .otherwise(F.col(REASON)))
              .drop(flag))
    return df


def key_column(schema, c: str, collation: str | None) -> Column:
    """A key's column; strings under a collation, so that equal means equal there."""
    return F.collate(F.col(c), collation) if collation and schema[c].dataType.simpleString() == "string" else F.col(c)


def inspect_batch(s: School, table: str, batch: DataFrame, order: list[str], skip: tuple[str, ...] = (), with_ids: bool | None = None,
                  check_current: bool = True, check_batch: bool = True, enforce_closed: bool = False, collation: str | None = None,
                  tag: str = "") -> tuple[DataFrame, list[str]]:
    """``batch`` with defaults applied and what ``settle`` needs, and the names of the unique keys.

    Added columns (all with ``tag``): ``_own``, the reason why a row is refused by itself;
    ``_outer``, that of a missing parent or closed year; for key i ``_first{i}``, the order of the first row
    (with no ``_own``) that has the value, ``_many{i}``, whether others have it too, and ``_taken{i}``,
    whether the table holds it.
    """
    schema = SCHEMAS[table]
    pk = PRIMARY_KEYS[table]
    # Key checks on the id only when the batch brings ids (otherwise they are all new).
    with_ids = (pk in batch.columns) if with_ids is None else with_ids
    cols = {f.name for f in schema.fields}
    for c in sorted(cols - set(batch.columns)):
        batch = batch.withColumn(c, F.lit(None).cast(schema[c].dataType))
    for c, v in DEFAULTS.get(table, {}).items():
        batch = batch.withColumn(c, F.coalesce(F.col(c), F.lit(v)))

    checks = [(F.col(c).isNull(), f"missing:{c}") for c in not_null_columns(table) if c != pk and c not in skip]
    checks += [(F.col(c).isNotNull() & ~F.col(c).isin(list(vals)), f"bad_value:{c}")
               for c, vals in ALLOWED_VALUES.get(table, {}).items() if c not in skip]
    checks += [(F.length(c) > n, f"too_long:{c}") for c, n in MAX_LENGTHS.get(table, {}).items() if c not in skip]
    own = f"_own{tag}"
    df = batch.withColumn(own, _first_reason(checks))

    keys = ([[pk]] if with_ids else []) + [list(k) for k in UNIQUE_KEYS.get(table, [])]
    ok = df.where(F.col(own).isNull())
    for i, k in enumerate(keys if (check_batch or check_current) else []):
        # One summary row per key value of the batch: its first row (by order), whether more rows
        # have it and whether the current table already holds it.  Joined back once.
        parts = [f"_k{j}" for j in range(len(k))]
        value = lambda frame: [key_column(schema, c, collation).alias(p) for c, p in zip(k, parts)]  # noqa: E731,B023
        present = ok.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in k])).select(*value(ok), F.struct(*order).alias("_rank"))
        info = present.groupBy(*parts).agg(F.min("_rank").alias(f"_first{tag}{i}"), (F.count("*") > 1).alias(f"_many{tag}{i}"))
        taken = F.lit(False)
        if check_current:
            current = s.table(table)
            info = info.join(by_key(current.select(*value(current)).distinct()).withColumn("_there", F.lit(True)), parts, "left")
            taken = F.col("_there").isNotNull()
        info = info.select(*parts, f"_first{tag}{i}", f"_many{tag}{i}", taken.alias(f"_taken{tag}{i}"), F.lit(0).cast("long").alias("_spread"))
        df = spread_nulls(df, k, order).select("*", *value(df)).join(by_key(info), [*parts, "_spread"], "left").drop("_spread", *parts)
    flags = []
    for child, col, parent, ppk, _rule in FOREIGN_KEYS:
        if child != table or col in skip:
            continue
        wanted = ok.where(F.col(col).isNotNull()).select(col).distinct()
        side = (lambda x: x) if parent in BY_YEAR else by_key
        missing = side(wanted.join(side(s.table(parent).select(F.col(ppk).alias(col))), col, "left_anti"))
        flags.append(([col], missing, f"missing_parent:{col}"))
    if enforce_closed:
        closed = s.academic_years.where(F.col("is_closed").eqNullSafe(True)).select("academic_year_id")
        if "academic_year_id" in cols and table != "academic_years":
            flags.append((["academic_year_id"], closed, "closed_year"))
        elif "enrollment_id" in cols and table != "student_enrollments":
            flags.append((["enrollment_id"], by_key(s.student_enrollments.join(closed, "academic_year_id", "left_semi")), "closed_year"))
    # A row that fails alone keeps its own reason.
    df = _flag_keys(df.withColumn(REASON, F.col(own)), flags, order)
    df = df.withColumn(f"_outer{tag}", F.when(F.col(own).isNull(), F.col(REASON))).drop(REASON)
    return df, [",".join(k) for k in keys] if check_batch or check_current else []


def settle(df: DataFrame, sides: list[tuple[str, list[str]]], order: list[str], row_key: list[str], check_batch: bool = True,
           prior: str | None = None, ordered: bool = False) -> DataFrame:
    """The inspected batch with ``reason``, NULL for rows that are stored when the batch is taken in ``order``.

    ``sides``: (tag, key names) of each table that ``inspect_batch`` has looked at; a row is stored in
    all of them or in none.  Rows that are refused for themselves, for a parent, for a value that a
    table holds or for ``prior`` (a column with a reason) hold no values; the others are accepted in order.
    A row with several faults names its own first, then keys, parents, and ``prior``.
    With ``ordered`` the result is globally sorted by ``order`` and checkpointed.
    """
    rank = F.struct(*order)
    keys = [(tag, i, name) for tag, names in sides for i, name in enumerate(names)]
    faults = [F.col(f"_{x}{tag}").isNotNull() for tag, _ in sides for x in ("own", "outer")]
    faults += [F.coalesce(f"_taken{tag}{i}", F.lit(False)) for tag, i, _ in keys] + ([F.col(prior).isNotNull()] if prior else [])
    lost = lambda n: F.lit(False)
    sort = lambda frame: cut_lineage(frame.orderBy(*order)) if ordered else frame
    contested = False
    if check_batch and keys:
        df = sort(df) if ordered else cut_lineage(df)
        contested = not df.where(reduce(lambda a, b: a | b, [F.coalesce(f"_many{tag}{i}", F.lit(False)) for tag, i, _ in keys])).isEmpty()
    elif ordered:
        df = sort(df)
    if contested:
        claim = F.array(*[F.when(F.col(f"_many{tag}{i}"), F.struct(F.lit(n).alias("key"), F.col(f"_first{tag}{i}").alias("holder"))) for n, (tag, i, _) in enumerate(keys)])
        claims = (df.select(F.struct(*row_key).alias("row"), rank.alias("rank"), (~reduce(lambda a, b: a | b, faults)).alias("eligible"), F.explode(claim).alias("claim"))
                  .where("claim is not null").select("row", "rank", "eligible", "claim.*"))
        df = df.withColumn("_me", F.struct(*row_key)).join(by_key(beaten(claims)).select(F.col("row").alias("_me"), F.col("keys").alias("_lost")), "_me", "left").drop("_me")
        lost = lambda n: F.coalesce(F.array_contains("_lost", n), F.lit(False))
    reasons = []
    for tag, names in sides:
        reasons.append(F.col(f"_own{tag}"))
        for n, (other, i, name) in enumerate(keys):
            if other == tag:
                taken = F.coalesce(f"_taken{tag}{i}", F.lit(False))
                later = taken & (rank != F.col(f"_first{tag}{i}")) if check_batch else F.lit(False)
                reasons.append(F.when(later | lost(n), F.lit(f"duplicate_in_batch:{name}")).when(taken, F.lit(f"duplicate_key:{name}")))
        reasons.append(F.col(f"_outer{tag}"))
    made = [f"_{x}{tag}" for tag, _ in sides for x in ("own", "outer")] + [f"_{x}{tag}{i}" for tag, i, _ in keys for x in ("first", "many", "taken")]
    out = df.withColumn(REASON, F.coalesce(*reasons, *([F.col(prior)] if prior else []))).drop(*made, "_lost")
    return sort(out) if contested else out


def validate_batch(s: School, table: str, batch: DataFrame, order_by: list[str],
                   skip: tuple[str, ...] = (), with_ids: bool | None = None,
                   row_key: list[str] | None = None, check_current: bool = True,
                   check_batch: bool = True, enforce_closed: bool = False,
                   collation: str | None = None, prior: str | None = None, ordered: bool = False) -> DataFrame:
    """``batch`` with defaults applied and a ``reason`` column (NULL when the row is acceptable).

    Rows are taken in order, as if stored one by one: a row is a duplicate in the batch only of an
    accepted row before it.  ``row_key`` identifies a batch row: by default a unique ``_row``
    position the batch carries (``order_by`` + ``_row`` is then a total order); or ``order_by``
    itself when the caller guarantees it is unique.  ``skip`` lists columns that the caller has
    already proven; ``check_current=False`` skips the key clash against the current table (when
    the caller removed those keys); ``check_batch=False`` skips in-batch duplicate checks (when
    the batch holds distinct keys).  ``enforce_closed`` refuses rows of a closed academic year
    (``closed_year``), found by the row's year or by the year of its enrollment.  ``collation``
    compares the strings of unique keys, e.g. ``UNICODE_CI_AI`` without regard to case and
    accents.  ``prior`` names a column with the caller's own reason to refuse a row; ``ordered`` asks
    for a result that is globally sorted and checkpointed.
    """
    row_key = row_key or ["_row"]
    order = list(dict.fromkeys([*order_by, *row_key]))
    df, names = inspect_batch(s, table, batch, order, skip, with_ids, check_current, check_batch, enforce_closed, collation)
    return settle(df, [("", names)], order, row_key, check_batch, prior, ordered)


def append_rows(s: School, table: str, batch: DataFrame, order_by: list[str],
                fill: dict[str, Column] | None = None, skip: tuple[str, ...] = (),
                id_base_from: DataFrame | None = None,
                check_current: bool = True, check_batch: bool = True,
                enforce_closed: bool = False, collation: str | None = None,
                generate: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted rows in the table's schema with new ids, rejected batch rows with a reason).

    ``order_by`` decides which of two clashing rows is kept and the order of
    the new ids; ties fall back to the batch's (checkpointed) row position.
    ``fill`` gives columns computed from the new id (e.g. a receipt number); ``generate``
    (column to prefix) those whose values must be new as well (``generate_unique``).
    ``collation`` compares the strings of unique keys.
    ``id_base_from`` is the table whose maximum id new ids continue after
    (default: the current table).

    The batch is checkpointed first: its row position is then the same on any
    recomputation, and the several validation joins read it instead of
    recomputing its lineage.
    """
    pk = PRIMARY_KEYS[table]
    b, row_key = cut_lineage(batch).withColumn("_row", F.monotonically_increasing_id()), ["_row"]
    order = list(dict.fromkeys([*order_by, *row_key]))
    # One checkpoint of the validated batch, globally sorted: ids are numbered on it directly.
    checked = validate_batch(s, table, b, order_by, skip, row_key=row_key, check_current=check_current, check_batch=check_batch,
                             enforce_closed=enforce_closed, collation=collation, ordered=True)
    rejected = checked.where(F.col(REASON).isNotNull()).drop("_row")
    ok = checked.where(F.col(REASON).isNull()).drop(REASON)
    given = ok.where(F.col(pk).isNotNull())
    # New ids continue after both the table's ids and any ids the batch brings itself.
    taken = (s.table(table) if id_base_from is None else id_base_from).select(pk).unionByName(given.select(pk))
    base = next_id_base(taken, pk, ID_START[table])
    new = assign_ids(ok.where(F.col(pk).isNull()).drop(pk), pk, base, order, presorted=True)
    accepted = given.unionByName(new).drop("_row")
    for c, expr in (fill or {}).items():
        accepted = accepted.withColumn(c, F.coalesce(F.col(c), expr))
    for c, prefix in (generate or {}).items():
        accepted = generate_unique(accepted, c, prefix, pk, s.table(table))
    return conform(accepted, table), rejected


def generate_unique(rows: DataFrame, col: str, prefix: str, id_col: str, stored: DataFrame) -> DataFrame:
    """``rows`` with the empty values of ``col`` filled by ``prefix`` and the row's id, which is new in
    ``id_col``, unless a row of ``rows`` or ``stored`` has that value.  Rows whose value is taken get,
    in the order of their ids, numbers behind all ids and all numbers that follow the prefix anywhere.

    Candidates meet the given and stored values in one anti join; numbers are assigned without
    moving rows through one task.
    """
    rows = cut_lineage(rows)
    taken = rows.select(col).unionByName(stored.select(col)).where(F.col(col).isNotNull()).distinct()
    own = F.concat(F.lit(prefix), F.col(id_col).cast("string"))
    given, empty = rows.where(F.col(col).isNotNull()), rows.where(F.col(col).isNull()).withColumn(col, own)
    free, moved = empty.join(by_key(taken), col, "left_anti"), empty.join(by_key(taken), col, "left_semi")
    number = F.when(F.col(col).startswith(prefix), F.try_to_number(F.substring(col, len(prefix) + 1, 18), F.lit("9" * 18))).cast("long")
    last = rows.select(F.col(id_col).alias("n")).unionByName(stored.select(F.col(id_col).alias("n"))).unionByName(
        taken.where(F.length(col) <= len(prefix) + 17).select(number.alias("n")))
    moved = assign_ids(moved.drop(col), "_number", next_id_base(last, "n", 1), [id_col])
    return given.unionByName(free).unionByName(moved.withColumn(col, F.concat(F.lit(prefix), F.col("_number").cast("string"))).drop("_number"))


def append(s: School, table: str, accepted: DataFrame) -> School:
    """The school with ``accepted`` rows added to ``table``."""
    return s.replace(**{table: s.table(table).unionByName(conform(accepted, table))})


def payment_receipt() -> Column:
    """Receipt number made from the new payment id (unique by construction)."""
    return F.concat(F.lit("RCP"), F.col("payment_id").cast("string"))


def one_per_key(df: DataFrame, key: list[str], by: list[str], largest: bool = True) -> DataFrame:
    """One row per ``key``: the row with the largest (or smallest) ``by`` values, then the
    largest remaining columns — a deterministic choice, unlike ``dropDuplicates``, so a
    recomputed partition keeps the same row.  Partial aggregation: skew-safe."""
    rest = [c for c in df.columns if c not in key and c not in by]
    pick = F.max if largest else F.min
    best = df.groupBy(*key).agg(pick(F.struct(*by, *rest)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in [*by, *rest]]).select(*df.columns)


# ---------------------------------------------------------------------------------------------
# Keyed update

def update_rows(df: DataFrame, changes: DataFrame, key: str | list[str],
                where: Column | None = None, order_by: list[str] | None = None) -> DataFrame:
    """W2 without checks: set the non-key columns of ``changes`` on the rows of ``df`` with the same key.

    ``where`` further restricts which matched rows change (e.g. ``role = 'teacher'``).  Of
    several changes of one key the first by ``order_by`` (then by the new values) counts.
    """
    key = [key] if isinstance(key, str) else list(key)
    cols = [c for c in changes.columns if c not in key and c in df.columns]
    changes = one_per_key(changes, key, order_by or [], largest=False)
    ch = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in cols]).withColumn("_hit", F.lit(True))
    joined = df.join(by_key(ch), key, "left")
    hit = F.col("_hit").isNotNull()
    if where is not None:
        hit = hit & F.coalesce(where, F.lit(False))
    out = [F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
           for c in df.columns]
    return joined.select(*out)


def update_table(s: School, table: str, changes: DataFrame, key: str | list[str] | None = None,
                 where: Column | None = None, order_by: list[str] | None = None, enforce_closed: bool = False,
                 collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the table with the accepted changes, the refused changes with a reason).

    The changed columns are checked as for new rows: missing value, allowed values, lengths,
    parents, and keys that another row holds or an earlier accepted change takes (strings compared
    under ``collation``); ``enforce_closed`` refuses changes of rows of a closed year.  One change for each
    key counts, the first by ``order_by`` (then by the new values); the others are refused
    (``duplicate_in_batch``), as are keys without a row (``no_row``).  Rows that ``where``
    excludes stay and are not reported.
    """
    pk = PRIMARY_KEYS[table]
    key = [pk] if key is None else [key] if isinstance(key, str) else list(key)
    cols = [c for c in changes.columns if c not in key and c in SCHEMAS[table].names]
    b = cut_lineage(changes).withColumn("_row", F.monotonically_increasing_id())
    rank = F.struct(*(order_by or []), *cols, "_row")
    first = b.groupBy(*key).agg(F.min(rank).alias("_first"))
    b = b.join(by_key(first), key, "left").withColumn("_pre", F.when(
        reduce(lambda x, y: x | y, [F.col(k).isNull() for k in key]), F.lit("no_row"))
        .when(rank != F.col("_first"), F.lit(f"duplicate_in_batch:{','.join(key)}"))).drop("_first")
    current = s.table(table)
    rows = current if where is None else current.withColumn("_where", F.coalesce(where, F.lit(False)))
    keep = [c for c in current.columns if c not in cols] + ([] if where is None else ["_where"])
    hit = b.where("_pre is null").join(by_key(rows.select(*keep)), key)
    if where is not None:
        hit = hit.where("_where").drop("_where")
    known = b.where("_pre is null").join(by_key(current.select(*key).distinct()), key, "left_anti").select("_row", F.lit("no_row").alias("_none"))
    # A refused key clash is judged against the other rows as they are now.
    proven = tuple(c for c in SCHEMAS[table].names if c not in cols)
    checked = hit.drop("_pre")
    for i, k in enumerate(UNIQUE_KEYS.get(table, [])):
        if not set(k) & set(cols):
            continue
        parts = [f"_k{j}" for j in range(len(k))]
        value = [key_column(SCHEMAS[table], c, collation).alias(p) for c, p in zip(k, parts)]
        others = current.select(*value, F.col(pk).alias("_other"))
        taken = checked.select(pk, *value).join(by_key(others), parts).where(F.col("_other") != F.col(pk)).select(pk).distinct().withColumn(f"_clash{i}", F.lit(f"duplicate_key:{','.join(k)}"))
        checked = checked.join(by_key(taken), pk, "left")
    clashes = [c for c in checked.columns if c.startswith("_clash")]
    checked = checked.withColumn("_clash", F.coalesce(*clashes) if clashes else F.lit(None).cast("string")).drop(*clashes)
    checked = cut_lineage(validate_batch(s, table, cut_lineage(checked), order_by or [], proven, with_ids=False, check_current=False,
                                         enforce_closed=enforce_closed, collation=collation, prior="_clash"))
    accepted = checked.where(F.col(REASON).isNull()).select(pk, *cols)
    told = checked.where(F.col(REASON).isNotNull()).select("_row", F.col(REASON).alias("_late"))
    rejected = (b.join(by_key(known), "_row", "left").join(by_key(told), "_row", "left").withColumn(REASON, F.coalesce("_pre", "_none", "_late"))
                .where(F.col(REASON).isNotNull()).select(*changes.columns, REASON))
    return update_rows(current, accepted, pk), rejected


def changed_count(df: DataFrame, changes: DataFrame, key: str | list[str], where: Column | None = None) -> DataFrame:
    """Number of rows an ``update_rows`` with the same arguments changes (one-row frame)."""
    key = [key] if isinstance(key, str) else list(key)
    m = df.join(by_key(changes.select(*key).distinct()), key, "left_semi")
    if where is not None:
        m = m.where(where)
    return m.agg(F.count(F.lit(1)).alias("changed"))


def set_columns(df: DataFrame, keys: DataFrame, key: str, values: dict[str, object],
                where: Column | None = None) -> DataFrame:
    """W2 with constant values (activate/deactivate users, close years, …)."""
    ch = keys.select(key).distinct()
    for c, v in values.items():
        ch = ch.withColumn(c, F.lit(v).cast(df.schema[c].dataType))
    return update_rows(df, ch, key, where)


# ---------------------------------------------------------------------------------------------
# W3, W4

def update_student_contact(s: School, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes (user_id, mobile, email, address) → (new student_master, refused changes).

    The user is resolved through their active-year enrollment to the student; a user
    without one is refused (``no_row``).
    """
    from rollbook.plans.dims import in_active_year
    enr = in_active_year(s.student_enrollments, s.academic_years).where("user_id is not null").select("user_id", "student_master_id")
    enr = one_per_key(enr, ["user_id"], ["student_master_id"], largest=False)
    resolved = changes.select("user_id", "mobile", "email", "address").join(by_key(enr), "user_id", "left")
    table, refused = update_table(s, "student_master", resolved, "student_master_id", order_by=["user_id"])
    return table, refused.drop("student_master_id")


def toggle_status(enrollments: DataFrame, keys: DataFrame) -> DataFrame:
    """Flip 'active' ↔ 'left' on the keyed enrollments (anything else becomes 'active')."""
    k = keys.select("enrollment_id").distinct().withColumn("_hit", F.lit(True))
    j = enrollments.join(by_key(k), "enrollment_id", "left")
    new = F.when(F.col("status") == "active", F.lit("left")).otherwise(F.lit("active"))
    return j.select(*[F.when(F.col("_hit").isNotNull(), new).otherwise(F.col("status")).alias("status")
                      if c == "status" else F.col(c) for c in enrollments.columns])


# ---------------------------------------------------------------------------------------------
# W5, W6, W7

def assign_fees(s: School, batch: DataFrame, mode: str = "upsert", enforce_closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Batch (enrollment_id, total_amount, assigned_date) → (new student_fee_assignments, refused rows).

    ``upsert``: every existing assignment of a batch enrollment gets the new
    amount and date; enrollments without one get a new row.  ``append``: every
    batch row is a new assignment (what the bulk form does).  Rows are checked
    first: a refused row changes nothing.  Of several accepted rows of an enrollment the
    upsert takes the latest date, then the larger amount.
    """
    if mode not in ("upsert", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    table, cols = "student_fee_assignments", ["enrollment_id", "total_amount", "assigned_date"]
    cur = s.student_fee_assignments
    if mode == "append":
        accepted, rejected = append_rows(s, table, batch.select(*cols), ["enrollment_id", "total_amount"], enforce_closed=enforce_closed)
        return cur.unionByName(accepted), rejected.select(*cols, REASON)
    checked = _checked(s, table, batch.select(*cols), ["enrollment_id"], enforce_closed=enforce_closed)
    b = one_per_key(checked.where(F.col(REASON).isNull()).select(*cols), ["enrollment_id"], ["assigned_date", "total_amount"])
    fresh = b.join(by_key(cur.select("enrollment_id").distinct()), "enrollment_id", "left_anti")
    accepted, _proven = append_rows(s, table, fresh, ["enrollment_id", "total_amount"], skip=("enrollment_id", "total_amount", "assigned_date"))
    return update_rows(cur, b, "enrollment_id").unionByName(accepted), checked.where(F.col(REASON).isNotNull()).select(*cols, REASON)


def _checked(s: School, table: str, batch: DataFrame, order_by: list[str], **how) -> DataFrame:
    """The batch with the reason of each refused row, kept; keys of the batch and the table may clash."""
    b = cut_lineage(batch).withColumn("_row", F.monotonically_increasing_id())
    return cut_lineage(validate_batch(s, table, b, order_by, check_current=False, check_batch=False, with_ids=False, **how))


def class_fee_flat_batch(s: School, classes: DataFrame, amount, assigned_date) -> DataFrame:
    """W5 bulk form: every active-year enrollment of the given classes at one amount."""
    from rollbook.plans.dims import in_active_year
    enr = in_active_year(s.student_enrollments, s.academic_years).select("enrollment_id", "class_id")
    enr = enr.join(classes.select("class_id").distinct(), "class_id", "left_semi")
    return enr.select("enrollment_id", F.lit(amount).cast("decimal(10,2)").alias("total_amount"),
                      F.lit(assigned_date).cast("date").alias("assigned_date"))


def dedupe_assignments(assignments: DataFrame) -> DataFrame:
    """W5 cure: keep one assignment per enrollment (the lowest assignment id)."""
    first = assignments.groupBy("enrollment_id").agg(F.min("assignment_id").alias("assignment_id"))
    return assignments.join(by_key(first), ["enrollment_id", "assignment_id"], "left_semi")


def class_fee_batch(s: School, year: int, classes: DataFrame | None, as_of) -> DataFrame:
    """W6 batch: enrollments of the classes (any year) at their level's fee of ``year``."""
    enr = s.student_enrollments.select("enrollment_id", "class_id")
    if classes is not None:
        enr = enr.join(classes.select("class_id").distinct(), "class_id", "left_semi")
    fs = s.fee_structures.where(F.col("academic_year_id") == F.lit(year)).select("class_level", "total_amount")
    return (enr.join(F.broadcast(s.classes.select("class_id", "class_level")), "class_id")
            .join(F.broadcast(fs), "class_level")
            .select("enrollment_id", "total_amount", F.lit(as_of).cast("date").alias("assigned_date")))


def assign_class_fees(s: School, year: int, classes: DataFrame | None, as_of, enforce_closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new assignment rows from the fee structure, refused rows); levels without a structure drop out."""
    return append_rows(s, "student_fee_assignments", class_fee_batch(s, year, classes, as_of), ["enrollment_id"], enforce_closed=enforce_closed)


def upsert_fee_structure(s: School, batch: DataFrame, enforce_closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Insert or replace the amount on (class_level, academic_year_id) → (new fee_structures, refused rows).

    Rows are checked first: a refused row changes nothing.  Of several accepted rows of a
    level and year the largest amount counts.
    """
    key, cols = ["class_level", "academic_year_id"], ["class_level", "academic_year_id", "total_amount"]
    checked = _checked(s, "fee_structures", batch.select(*cols), key, enforce_closed=enforce_closed)
    b = one_per_key(checked.where(F.col(REASON).isNull()).select(*cols), key, ["total_amount"])
    fresh = b.join(s.fee_structures.select(*key), key, "left_anti")
    accepted, _proven = append_rows(s, "fee_structures", fresh, key, skip=("academic_year_id", "class_level", "total_amount"),
                                    check_current=False, check_batch=False)
    return update_rows(s.fee_structures, b, key).unionByName(accepted), checked.where(F.col(REASON).isNotNull()).select(*cols, REASON)


# ---------------------------------------------------------------------------------------------
# W8

def mark_attendance(s: School, batch: DataFrame, order_by: list[str] | None = None,
                    enforce_closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Batch (enrollment_id, attendance_date, status) → (new attendance table, refused rows).

    Stored rows of an accepted (enrollment, date) are replaced (delete + insert,
    so they get new ids); a refused row leaves what is stored.  A repeated pair
    inside the batch is refused.
    """
    order_by = order_by or ["enrollment_id", "attendance_date"]
    key = ["enrollment_id", "attendance_date"]
    b = batch.select(*key, "status", *[c for c in order_by if c not in (*key, "status")])
    accepted, rejected = append_rows(s, "attendance_students", b, order_by, check_current=False, enforce_closed=enforce_closed)
    kept = conform(s.attendance_students.join(by_key(accepted.select(*key)), key, "left_anti"), "attendance_students")
    return kept.unionByName(accepted), rejected

"""Plan helpers: the active-year filter, key filters, lineage cuts.

Spark broadcasts a side whose size in bytes it knows (file statistics, or what a shuffle
has written) to be below its threshold; only years and classes, of which the declared keys
allow a few dozen for each year, are broadcast without asking.  What is known before a run are the bytes of compressed files, without the rows that an
``explode`` adds; a side that grows with the students is therefore marked ``by_key``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def active_year_ids(academic_years: DataFrame) -> DataFrame:
    """Ids of all active years (several may be active; all count)."""
    # `is_active <=> true` stays a comparison after optimisation (a bare boolean column does not),
    # so the semi-join prunes year partitions of the joined fact table (dynamic partition pruning).
    return academic_years.where(F.col("is_active").eqNullSafe(True)).select("academic_year_id")


def in_active_year(df: DataFrame, academic_years: DataFrame, col: str = "academic_year_id") -> DataFrame:
    """Rows of ``df`` whose ``col`` is an active year: a left-semi join."""
    ids = active_year_ids(academic_years)
    if col != "academic_year_id":
        ids = ids.withColumnRenamed("academic_year_id", col)
    return df.join(F.broadcast(ids), col, "left_semi")


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of the next join, which sorts and merges both sides by the key: neither is
    broadcast.  For sides with rows for each student, enrollment or fact, whose bytes in memory may
    be a hundred times those of the files that Spark estimates them by."""
    return df.hint("merge")


def restrict(df: DataFrame, keys: DataFrame | None, col: str) -> DataFrame:
    """Optional key filter: a semi-join with a DataFrame of keys (``None`` = whole table)."""
    if keys is None:
        return df
    k = keys.select(col).distinct()
    return df.join(k, col, "left_semi")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir`` of the session.

    Only when nothing is configured *and* the master is local (tests, one
    machine) a fresh folder under /tmp is used; on a cluster an unset folder
    is an error, never a machine-local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rollbook-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running table changes")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared checkpoint folder; its owner clears it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"

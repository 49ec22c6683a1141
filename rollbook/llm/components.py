"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.base import materialise


#: Tasks over which the rows of one key are dealt.
SALTS = 32


def with_least(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the least ``value`` among the rows of the same ``keys``.

    The rows of a key are dealt over SALTS tasks by their value, and its minimum is sent to those
    of them that hold rows: a key with few rows costs no more copies than it has rows, and one with a
    third of all rows is no task of its own.  Rows with a null key are left out, repeated rows stay; ``rows``
    has no column ``salt``.
    """
    # One shuffle of the rows serves both the minimum and the join.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(SALTS))).repartition(*keys, "salt")
    least = (salted.groupBy(*keys, "salt").agg(F.min(value).alias(name))
             .groupBy(*keys).agg(F.min(name).alias(name), F.collect_list("salt").alias("salts"))
             .select(*keys, name, F.explode("salts").alias("salt")))
    return salted.join(least, [*keys, "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of each node on its least one; edges may repeat in the result."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hung = with_least(both, ["a"], "b", "m").where("b > a")
    return hung.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the least of these."""
    end = lambda n: F.struct(F.col(n).alias("a"), F.col("m").alias("b"))
    return with_least(edges, ["a"], "b", "m").select(F.inline(F.array(end("a"), end("b")))).where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of distinct ``edges`` (a > b) either hangs on one other or has others hang on it."""
    ends = edges.select(F.inline(F.array(*[F.struct(F.col(n).alias("node"), F.lit(up).alias("up")) for n, up in (("a", 1), ("b", 0))])))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or ups > least").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the least node of its component.

    The steps end in one star for each component, after a number of rounds that grows with
    the logarithm of the size; each round is written to the shared folder.  Whether all are stars
    is told by one count of each node's edges, so that no further round has to show that nothing changes.
    Repeated edges count once; loops and edges with a null end are
    left out, other columns are not read, and no edges give no rows.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _are_stars(edges):
        edges = materialise(_small_star(_large_star(edges)), "edges")
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))

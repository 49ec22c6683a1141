"""Benchmark decontamination: size-partitioned MinHash containment search, all native.

An item leaks into a document that holds at least the threshold's share of the item's
word shingles.  Items are partitioned by the size of their shingle set, and each
partition has its own number of MinHash values: one more than the shingles that an item
of that partition may miss, so that a document at the threshold holds one of them for
certain.  A document is a hundred times longer than an item, hence its signature
would tell nothing; the items' values are looked up among all its shingles instead.
Candidates are verified by exact containment of the shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.base import materialise

SHINGLE = 5
PERCENT = 80
#: The items' values are broadcast up to this many rows (8 bytes of key each), joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def words(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}]+)"), 1)


def shingles(tokens: str, n: int) -> Column:
    """Hashes of all n-word shingles of an array column, none if it is shorter."""
    at = lambda i: F.xxhash64(F.lit(n), *[F.get(F.col(tokens), i + k) for k in range(n)])
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), at))


def item_sets(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words in a shingle), set (distinct shingle hashes), size.

    An item of fewer than SHINGLE words is one shingle of all its words; null items and
    items without words are left out, equal texts of one id count once.
    """
    tokens = benchmark.select("item_id", words("text").alias("tokens")).where(F.size("tokens") > 0).distinct()
    n = F.least(F.size("tokens"), F.lit(SHINGLE))
    sized = F.coalesce(*[F.when(n == k, F.array_distinct(shingles("tokens", k))) for k in range(1, SHINGLE + 1)])
    return tokens.select("item_id", n.alias("n"), sized.alias("set")).withColumn("size", F.size("set"))


def signatures(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item_id, value): the MinHash values of each item, as many as its size partition needs."""
    upper = F.pow(F.lit(2.0), F.floor(F.log2(F.col("size").cast("double"))) + 1) - 1
    allowed = F.floor(upper * (100 - percent) / 100).cast("int") + 1
    ordered = F.array_sort(F.transform("set", lambda s: F.struct(F.xxhash64(s, F.lit(3)).alias("h"), s.alias("s"))))
    return items.select("item_id", F.explode(F.slice(ordered, 1, F.least(allowed, "size"))).alias("v")).select("item_id", F.col("v.s").alias("value"))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of each item that leaks into a document.

    Null and empty texts hold nothing.  Rows of one doc_id are looked at one by one, and the
    row that holds most of an item counts; equal item ids likewise.
    """
    spark = docs.sparkSession
    items = materialise(item_sets(benchmark.select("item_id", "text")), "items")
    values = materialise(signatures(items, percent), "signatures")
    few = values.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = F.broadcast(values) if few else values
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most SHINGLE numbers
    texts = docs.select("doc_id", words("text").alias("tokens"))
    if not lengths:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, "
                                         "n_shared int, n_item int, containment double")
    all_shingles = F.concat(*[F.coalesce(shingles("tokens", n), F.array().cast("array<bigint>")) for n in lengths])
    found = (texts.select("doc_id", F.explode(all_shingles).alias("value")).join(held, "value")
             .select("doc_id", "item_id").distinct())
    pairs = materialise(found, "candidates")
    shared = F.coalesce(*[F.when(F.col("n") == n, F.size(F.array_intersect("set", shingles("tokens", n)))) for n in lengths])
    return (texts.join(pairs.withColumnRenamed("doc_id", "found_id"), F.col("doc_id").eqNullSafe(F.col("found_id")))
            .join(items, "item_id").withColumn("n_shared", shared).where(100 * F.col("n_shared") >= percent * F.col("size"))
            .groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("size")).alias("share"), "n_shared", "size")).alias("best"))
            .select("doc_id", "item_id", "best.n_shared", F.col("best.size").alias("n_item"), F.col("best.share").alias("containment")))

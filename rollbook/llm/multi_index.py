"""Approximate nearest neighbours by an inverted multi-index.

Each vector is cut into two halves, and each half is quantised by a codebook of its own;
a cell is a pair of centroids.  A query walks the pairs by the sum of its two halves'
distances with a heap until the cells hold enough entries, and the entries of those
cells are reranked by the exact inner product.  The cells of the index and the cells
that queries want meet in a join, in blocks of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.base import materialise

#: Vectors each codebook is fitted on (by a hash of the id), its size, and its rounds.
FIT_ROWS, CENTROIDS, ROUNDS = 20_000, 64, 12
#: A query looks at cells until they hold this share of all entries, at least so many.
SHARE, LEAST = 0.5, 256
#: Entries per block and queries per block of a cell.
BLOCK, QUERY_BLOCK = 4096, 512


def codebook(rows: np.ndarray, size: int, seed: int) -> np.ndarray:
    """k-means from rows drawn by distance; fewer centroids if there are fewer different rows."""
    rng = np.random.default_rng(seed)
    different = np.unique(rows, axis=0)
    if len(different) <= size:
        return different
    centroids = [different[rng.integers(len(different))]]
    near = ((different - centroids[0]) ** 2).sum(1)
    while len(centroids) < size:
        centroids.append(different[rng.choice(len(different), p=near / near.sum())])
        near = np.minimum(near, ((different - centroids[-1]) ** 2).sum(1))
    centroids = np.array(centroids)
    for _ in range(ROUNDS):
        own = nearest(rows, centroids)
        n = np.bincount(own, minlength=len(centroids))
        sums = np.stack([np.bincount(own, rows[:, d], len(centroids)) for d in range(rows.shape[1])], 1)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    for i in range(0, len(rows), 8192):
        part = rows[i:i + 8192]
        out[i:i + 8192] = ((centroids ** 2).sum(1) - 2 * part @ centroids.T).argmin(1)
    return out


def cells_of_query(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells by rising sum of two distances, until they hold ``wanted`` entries.

    The multi-sequence walk: a pair of places (i, j) in the two sorted lists enters the heap
    once (i - 1, j) and (i, j - 1) are done.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, table = first[a].tolist(), second[b].tolist(), counts[np.ix_(a, b)].tolist()
    heap, reached, out, held = [(x[0] + y[0], 0, 0)], [0] * len(x), [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        if table[i][j]:
            out.append(int(a[i]) * len(b) + int(b[j]))
            held += table[i][j]
        reached[i] = j + 1
        if i + 1 < len(x) and reached[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < len(y) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up from the first component to the last: equal vectors give equal sums."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) once each, without null, empty or zero vectors or ones with null or non-finite components."""
    v = F.col("vector")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
            .where("id is not null and size(vector) > 0").where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0)).distinct())


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def best_of_block(entries: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best entries of one block for each query, among the cells that it wants.

    Scores from matrix products only choose candidates, with room for rounding; these are
    scored again by :func:`inner_products`, so that ties are true ties.
    """
    if not len(entries) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    e, q = np.stack(entries["vector"]).astype(np.float64), np.stack(queries["vector"]).astype(np.float64)
    ids, asks, second = entries["id"].to_numpy(), queries["query_id"].to_numpy(), entries["second"].to_numpy()
    found = np.full((len(q), len(e)), -np.inf)
    wants = np.zeros((len(q), second.max() + 1), bool)
    for i, wanted in enumerate(queries["wanted"]):
        wants[i, wanted[wanted <= second.max()]] = True
    for cell in np.unique(second):
        rows, columns = np.flatnonzero(wants[:, cell]), np.flatnonzero(second == cell)
        if len(rows):
            found[np.ix_(rows, columns)] = q[rows] @ e[columns].T
    found[asks[:, None] == ids[None, :]] = -np.inf
    least = np.partition(found, -min(k, len(e)), 1)[:, -min(k, len(e))]
    finite = np.isfinite(found)
    room = 1e-9 * np.abs(found[finite]).max(initial=1.0)
    rows, columns = np.nonzero(finite & (found >= least[:, None] - room))
    score = inner_products(q[rows], e[columns])
    order = np.lexsort((ids[columns], -score, rows))
    rows, columns, score = rows[order], columns[order], score[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < k
    return pd.DataFrame({"query_id": asks[rows[keep]], "vec_id": ids[columns[keep]], "score": score[keep]})


def search(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           centroids: int = CENTROIDS, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k largest inner products found for each
    row whose id satisfies ``is_query``, among all rows with another id.

    Ties go to the smaller id, equal rows count once.  Vectors of another length than the most
    frequent one and unusable ones take no part.  A query looks at
    ``least`` different vectors at least, and at enough to fill its answer, so that a table of no
    more than those is searched whole; no queries or no vectors give no rows.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, id_col, vector_col), "vectors")
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths["d"]
    half = (dim + 1) // 2
    rows = rows.where(F.size("vector") == dim)
    # Of equal vectors only the k + 1 smallest ids can be in an answer (a query skips its own).
    entries = rows.withColumn("copy", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("copy") <= k + 1)

    def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[:, :half], v[:, half:] if dim > half else np.zeros((len(v), 1))

    fitted = matrix(rows.orderBy(F.xxhash64("id", F.lit(8)), "id").limit(FIT_ROWS).select("vector").toArrow().column(0).combine_chunks(), dim)
    books = [codebook(part, centroids, seed) for seed, part in enumerate(halves(fitted))]
    shipped = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = halves(matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(a, shipped.value[0])), pa.array(nearest(b, shipped.value[1]))],
                                             ["id", "vector", "copy", "first", "second"])

    kind = rows.schema["vector"].dataType.simpleString()
    entries = materialise(entries.mapInArrow(assign, f"id long, vector {kind}, copy int, first long, second long"), "cells")
    # At most one row per cell. Copies count once: a query's share is of different vectors.
    sizes = entries.where("copy = 1").groupBy("first", "second").count().collect()
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in sizes:
        counts[r["first"], r["second"]] = r["count"]
    total = int(counts.sum())
    walk = spark.sparkContext.broadcast((books, counts, min(total, max(least, k + 1, int(np.ceil(share * total))))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (left, right), table, goal = walk.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                part = batch.slice(begin, 100)
                a, b = halves(matrix(part.column(1), dim))
                at, first, wanted = [], [], []
                for i, (x, y) in enumerate(zip(-a @ left.T, -b @ right.T)):
                    cells = np.array(cells_of_query(x, y, table, goal), np.int64)
                    for f in np.unique(cells // len(right)):
                        at.append(i)
                        first.append(f)
                        wanted.append(cells[cells // len(right) == f] % len(right))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), part.column(1).take(pa.array(at, pa.int64())),
                                                  pa.array(first, pa.int64()), pa.array(wanted, pa.list_(pa.int64()))], ["query_id", "vector", "first", "wanted"])

    queries = materialise(rows.where(is_query(F.col("id"))).mapInArrow(route, f"query_id long, vector {kind}, first long, wanted array<long>"), "routes")
    # One row per centroid of the first half says into how many blocks its entries and queries are cut.
    cut = (entries.groupBy("first").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
           .join(queries.groupBy("first").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts")), "first"))
    cut = F.broadcast(cut)
    left = entries.join(cut, "first").select(
        "first", "id", "vector", "second", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = queries.join(cut, "first").select(
        "first", "query_id", "vector", "wanted", F.pmod(F.xxhash64("query_id"), "parts").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    key = ["first", "block", "part"]
    found = (left.groupBy(*key).cogroup(right.groupBy(*key))
             .applyInPandas(lambda e, q: best_of_block(e, q, k), "query_id long, vec_id long, score double"))
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # Different vectors of one id are one candidate, by the best of them.
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Quality classifier: importance resampling with hashed n-gram models (Gumbel top-k).

Two multinomial models over hashed word n-grams, one of target text and one of the
raw corpus; a document's log importance weight is the sum of log(target / raw) over
its n-grams.  Gumbel noise, drawn from a hash of the id, is added, and the k largest
keys are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.base import materialise, with_scores

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 16
#: Bound of the labelled target documents that the target model is fitted on.
TARGET_SAMPLE = 20_000
SEED = 20
BINS = 4096


class Hashes(dict):
    """Token -> crc32, remembered; emptied once it has grown large."""

    def __missing__(self, token: str) -> int:
        self[token] = h = crc32(token.encode("utf-8", "surrogatepass"))
        return h


def ngram_buckets(text: str | None, hashes: Hashes) -> np.ndarray:
    """Buckets of the unigrams and bigrams.  A token equal to the one before counts as a
    marker of repetition, whatever the token is."""
    tokens = TOKEN.findall(text.lower()) if text else []
    if not tokens:
        return np.empty(0, np.int64)
    if len(hashes) > 500_000:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    h[again] = 1
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    pairs ^= pairs >> np.uint64(32)
    return (np.concatenate([h * np.uint64(2654435761) >> np.uint64(7), pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
        label_col: str = "quality", target_sample: int = TARGET_SAMPLE) -> np.ndarray:
    """log(target / raw) for each bucket, with one added to every count.

    The raw model counts all documents.  The target model counts at most ``target_sample``
    documents labelled 1, chosen by a hash of the id; null ids and labels are not used, and
    an id labelled both ways is not a target.  Without targets every ratio is 0.
    """
    wanted = (labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
              .where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y")).where("y = 1")
              .orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(target_sample).select("id", F.lit(True).alias("target")))
    # At most target_sample ids by construction, hence the broadcast.
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
            .join(F.broadcast(wanted), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, raw, target = Hashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, is_target in zip(batch.column(0), batch.column(1).to_pylist()):
                buckets = ngram_buckets(text.as_py(), hashes)
                if len(buckets):
                    found = np.bincount(buckets, minlength=BUCKETS) if len(buckets) > BUCKETS // 8 else None
                    for into in (raw, target)[:1 + is_target]:
                        if found is not None:
                            into += found
                        else:
                            np.add.at(into, buckets, 1)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    found = (rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket")
             .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow())  # at most BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = found.column("bucket").to_numpy()
    raw[at], target[at] = found.column("raw").to_numpy(), found.column("target").to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def weigh(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``row``, ``log_weight`` (0 for null texts and texts without tokens) and ``key``, the
    weight with Gumbel noise from a hash of the id: the same for repeated rows."""
    shipped = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float32))

    def start():
        hashes, table = Hashes(), shipped.value

        def run(texts: list[str | None]) -> list[pa.Array]:
            return [pa.array([float(table[ngram_buckets(t, hashes)].sum(dtype=np.float64)) for t in texts], pa.float64())]

        return run

    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit("")), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return (with_scores(docs, text_col, start, [T.StructField("log_weight", T.DoubleType())])
            .withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))))


def kth_largest(keys: DataFrame, k: int, col: str = "key") -> float | None:
    """The exact k-th largest value of a column, None if there are at most k rows.

    Each pass counts the rows of at most BINS equal ranges and goes on in the one that
    holds the k-th; only these counts come to the driver.
    """
    inside = keys.select(F.col(col).alias("key"))
    low, high, n = inside.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n <= k:
        return None
    while k > 0 and low < high:
        width = (high - low) / BINS
        bins = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)) if width > 0 else F.col("key")
        found = (inside.where(F.col("key").between(low, high)).groupBy(bins.alias("bin"))
                 .agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect())
        for row in sorted(found, key=lambda r: -r["low"]):
            if row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]
    return high if k > 0 else math.inf


def best_cut(weights: np.ndarray, target: np.ndarray) -> float:
    """The weight that parts labelled targets from the others with the fewest errors; of a
    range of equally good ones the middle.  Everything passes if either kind is missing."""
    if not target.any() or target.all():
        return -math.inf
    order = np.argsort(weights, kind="stable")
    weights, target = weights[order], target[order]
    errors = np.concatenate([[0], np.cumsum(target)]) + (len(target) - target.sum()) - np.concatenate([[0], np.cumsum(~target)])
    edges = np.concatenate([[weights[0]], (weights[1:] + weights[:-1]) / 2, [np.nextafter(weights[-1], math.inf)]])
    possible = np.concatenate([[True], weights[1:] > weights[:-1], [True]])
    return float(edges[possible][errors[possible].argmin()])


def sample_size(weighed: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", labelled: int = TARGET_SAMPLE) -> int:
    """How many rows to sample: as many as have at least the weight that best parts labelled
    targets from the others, learnt from at most ``labelled`` ids of each kind."""
    known = labels.select(F.col(label_id).cast("long").alias("doc_id"), (F.col(label_col) == 1).alias("target")).where("doc_id is not null and target is not null")
    known = known.groupBy("doc_id").agg(F.min("target").alias("target"))
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    some = known.where("target").orderBy(*order).limit(labelled).unionByName(known.where("not target").orderBy(*order).limit(labelled))
    # At most 2 * labelled ids by construction, hence the broadcast.
    found = (weighed.select("doc_id", "log_weight").join(F.broadcast(some), "doc_id")
             .groupBy("doc_id").agg(F.max("log_weight").alias("log_weight"), F.max("target").alias("target")).toArrow())
    cut = best_cut(found.column("log_weight").to_numpy(), np.array(found.column("target").to_pylist(), bool))
    return weighed.where(F.col("log_weight") >= cut).count()


def sample(weighed: DataFrame, k: int) -> DataFrame:
    """Mark the k rows with the largest keys as ``selected``.

    Rows that tie with the last (repeated ids) are all selected.  ``weighed`` is read several
    times: pass a written table.
    """
    edge = kth_largest(weighed, k)
    return weighed.withColumn("selected", F.lit(True) if edge is None else F.col("key") >= edge)


def weighed_table(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, log_weight and key of every document, written to the shared folder."""
    return materialise(weigh(docs.select("doc_id", "text"), ratios).select(F.col("row.doc_id").alias("doc_id"), "log_weight", "key"), "weights")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, key and selected for every document; k as by :func:`sample_size`."""
    weighed = weighed_table(docs, fit(docs, labels))
    return sample(weighed, sample_size(weighed, labels) if k is None else k)

"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.base import id_crc, with_scores

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: The log-probability matrix is broadcast: at most so many languages of 2**14 buckets.
MAX_LANGS = 512
SLICE = 500_000


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the bucket at each position of the joined texts, and the range of
    positions of each text (no gram crosses its end)."""
    lowered = [t.lower() for t in texts]
    ends = np.cumsum([len(t) for t in lowered])
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint32)
    h = np.zeros(len(codes), np.uint32)
    for n in ORDERS:
        shifted = codes[n - 1:]
        h = (h[:len(shifted)] * np.uint32(0x01000193)) ^ (shifted * np.uint32(0x9E3779B1) + np.uint32(n))
        mixed = h ^ (h >> np.uint32(15))
        last = len(h)
        yield ((mixed * np.uint32(0x85EBCA6B) >> np.uint32(18)).astype(np.int64), np.minimum(begins, last),
               np.minimum(np.maximum(ends - n + 1, begins), last))


def sliced(texts: list[str]) -> Iterator[slice]:
    """Ranges of texts with about SLICE characters together."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log-probability matrix) from all rows with a language and a letter.

    Counts are added up in each task and then by Spark, so that a language may have any share.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                if has_letter(text := text.as_py()):
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                into = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                into[BUCKETS] += len(texts)
                for part in sliced(texts):
                    for buckets, begins, ends in ngram_buckets(texts[part]):
                        inner = np.zeros(len(buckets) + 1, np.int32)
                        np.add.at(inner, begins, 1)
                        np.add.at(inner, ends, -1)
                        into[:BUCKETS] += np.bincount(buckets[np.cumsum(inner[:-1]) > 0], minlength=BUCKETS)
        for lang, into in counts.items():
            some = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(into[some])], ["lang", "bucket", "n"])

    counted = (rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
               .mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    found = counted.orderBy("lang", "bucket").limit((MAX_LANGS + 1) * (BUCKETS + 1)).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: the matrix would not fit a broadcast")
    row = {lang: i for i, lang in enumerate(langs)}
    matrix = np.zeros((len(langs), BUCKETS + 1))
    matrix[[row[x] for x in found.column("lang").to_pylist()], found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    docs, grams = matrix[:, BUCKETS], matrix[:, :BUCKETS]
    prior = np.log((docs + 1) / (docs.sum() + max(len(langs), 1)))
    return langs, prior, np.log((grams + 1) / (grams.sum(1, keepdims=True) + BUCKETS)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """``row``, ``lang_pred`` and ``score``, the posterior of that language.

    Null texts, texts without a letter, and all texts if nothing was learnt: ``und``, score 0.
    Equal posteriors go to the first language by name.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[list], list[pa.Array]]:
        langs, prior, matrix = shipped.value

        def run(texts: list[str | None]) -> list[pa.Array]:
            at = [i for i, t in enumerate(texts) if langs and has_letter(t)]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            rated = [texts[i] for i in at]
            for part in sliced(rated):
                total = np.repeat(prior[:, None], len(rated[part]), 1)
                for buckets, begins, ends in ngram_buckets(rated[part]):
                    for k in range(len(langs)):
                        sums = np.concatenate([[0.0], np.cumsum(matrix[k][buckets], dtype=np.float64)])
                        total[k] += sums[ends] - sums[begins]
                best = total.argmax(0)
                posterior = 1 / np.exp(total - total.max(0)).sum(0)
                for i, b, p in zip(at[part], best, posterior):
                    names[i], scores[i] = langs[b], float(p)
            return [pa.array(names), pa.array(scores)]

        return run

    return with_scores(docs, text_col, start, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def language_id(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learnt from the rows that
    are not held out (default: crc32 of the id mod 3 is 1)."""
    held = id_crc("doc_id") % 3 == 1 if held_out is None else held_out
    model = fit(docs.where(~held))
    return (predict(docs.select("doc_id", "text", held.alias("held_out")), model)
            .select("row.doc_id", "row.held_out", "lang_pred", "score"))

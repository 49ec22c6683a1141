"""Toxicity: class-conditional Kneser-Ney models over the characters of words.

Two models, of toxic and of ordinary text, predict each letter of a word (and its
end) from the five before it.  Each class has its own counts of six-character
grams; below them both classes back off to one shared chain of continuation
counts, so that a rare expression is judged by its stem and an unknown one alike
by both.  A document's evidence is the difference of the two log-likelihoods
divided by the number of predicted characters; a logistic curve fitted on
labelled documents kept out of the counts maps it to a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.base import id_crc, materialise, with_scores

WORD = re.compile(r"[^\W\d_]+")
ORDER = 6
BITS = 10
MASK = (1 << BITS) - 1
END = 1
DISCOUNT = 0.9
#: Bounds of the sample for each class: labelled documents, their characters in all and those of one
#: document.  The model holds every gram of the sample, which are no more than its characters and words.
SAMPLE_PER_CLASS = 6000
SAMPLE_CHARS, LONGEST = 16_000_000, 2_000_000
#: Tasks that read the sample.
PARTS = 32
CACHE = 500_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed six-character gram of each predicted character, and the word it is in.

    A letter's code is its code point folded into 10 bits (2 and up); 0 fills the
    context before a word and 1 is the word's end.
    """
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    points = np.frombuffer(("\x01".join(words) + "\x01").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(points == 1, END, 2 + points % (MASK - 1))
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys = codes.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(codes)
        before[back:] = codes[:-back]
        before[place < back] = 0
        keys |= before << (BITS * back)
    return keys, owner


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, weights, len(found))


def _at(found: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float) -> np.ndarray:
    if not len(found):
        return np.full(len(keys), default)
    i = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    return np.where(found[i] == keys, values[i], default)


def shared_backoff(keys: np.ndarray) -> np.ndarray:
    """Interpolated Kneser-Ney probability of the last character of each gram given the
    four before it, from continuation counts over the gram types of both classes."""
    types = np.unique(keys)
    lower: list[np.ndarray] = []
    for n in range(ORDER - 1, 0, -1):
        types = types & ((1 << (BITS * n)) - 1)
        lower.append(types)
        types = np.unique(types)
    prob_keys, prob = np.zeros(1, np.int64), np.full(1, 1.0 / MASK)
    for n, raw in zip(range(1, ORDER), reversed(lower)):
        found, count = _sums(raw, np.ones(len(raw)))
        context, total = _sums(found >> BITS, count)
        _, kinds = _sums(found >> BITS, np.ones(len(found)))
        below = _at(prob_keys, prob, found & ((1 << (BITS * (n - 1))) - 1), 1.0 / MASK)
        at = np.searchsorted(context, found >> BITS)
        prob = (count - DISCOUNT + DISCOUNT * kinds[at] * below) / total[at]
        prob_keys = found
    return _at(prob_keys, prob, keys & ((1 << (BITS * (ORDER - 1))) - 1), 1.0 / MASK)


def ratio_tables(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[np.ndarray, ...]:
    """log P_toxic - log P_ordinary for each known gram, and for the unknown grams of
    each known context (there only the weights of the shared backoff differ)."""
    order = np.argsort(keys)
    keys, shared = keys[order], shared_backoff(keys[order])
    contexts = np.unique(keys >> BITS)
    at = np.searchsorted(contexts, keys >> BITS)
    logs, weights = [], []
    for count in (toxic[order].astype(float), ordinary[order].astype(float)):
        total = np.bincount(at, count, len(contexts))
        kinds = np.bincount(at, count > 0, len(contexts))
        back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        own = np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1)[at]
        logs.append(np.log(own + back[at] * shared))
        weights.append(np.log(back))
    return keys, (logs[0] - logs[1]).astype(np.float32), contexts, (weights[0] - weights[1]).astype(np.float32)


class Evidence:
    """Length-normalised difference of the log-likelihoods; one object in each task."""

    def __init__(self, tables: tuple[np.ndarray, ...]):
        self.keys, self.ratio, self.contexts, self.unseen = tables
        self.cache: dict[str, float] = {}

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 200_000):
            part = words[i:i + 200_000]
            keys, owner = grams(part)
            other = _at(self.contexts, self.unseen, keys >> BITS, 0.0)
            if len(self.keys):
                j = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                other = np.where(self.keys[j] == keys, self.ratio[j], other)
            self.cache.update(zip(part, np.bincount(owner, other, len(part)).tolist()))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """For each text the evidence per character, the same per root of the length (its
        size in standard errors), and the inverse root of the length."""
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            if len(self.cache) > CACHE:
                self.cache.clear()
            known = self.cache
            new = [w for w in set(words) if w not in known]
            if new:
                self.learn(new)
            total, length = sum(map(known.__getitem__, words)), len(words) + sum(map(len, words))
            out[i] = total / length, total / length ** 0.5, 1 / length ** 0.5
        return out


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Logistic curve by Newton's method: weights of the scaled columns of x and a constant."""
    scale = np.maximum(x.std(0), 1e-9)
    features = np.column_stack([x / scale, np.ones(len(x))])
    theta = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -30, 30)))
        gradient = features.T @ (p - y) + 1e-2 * theta
        hessian = features.T @ (features * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(theta))
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return theta, scale


def sample(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
           label_id: str = "doc_id", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS,
           longest: int = LONGEST) -> DataFrame:
    """(id, y, h, text): at most ``per_class`` labelled documents and ``chars`` characters of each class, in
    the order of a hash of the id; texts are taken whole, those of more than ``longest`` characters are left out.

    An id with several labels counts as toxic if any says so, of its several texts the
    shortest is taken; null ids, labels and texts are left out.
    """
    known = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    if train is not None:
        known = known.where(train)
    known = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id", F.lit(17)))
    chosen = None
    for y in (1, 0):
        part = known.where(F.col("y") == y).orderBy("h", "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # At most 2 * per_class rows by construction, hence the broadcasts.
    found = (texts.where(F.length("text") <= longest).join(F.broadcast(chosen), "id")
             .groupBy("id", "y", "h").agg(F.min(F.struct(F.length("text").alias("size"), "text")).alias("t"))
             .select("id", "y", "h", "t.size", "t.text"))
    found = materialise(found.repartition(PARTS, "id"), "sample")
    # A window over the sizes of at most per_class rows.
    so_far = F.sum("size").over(Window.partitionBy("y").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    within = found.select("id", "y", so_far.alias("so_far")).where(F.col("so_far") <= chars).select("id")
    return found.join(F.broadcast(within), "id").select("id", "y", "h", "text")


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> dict:
    """Fit on a bounded ``sample`` of labelled documents; all its grams are counted and kept.

    Of these, four fifths (by hash) give the counts, the others the curve.  Without both
    classes the model is None: scores are 0 then.
    """
    rows = (sample(docs, labels, train, id_col, text_col, label_id, label_col, per_class)
            .select("text", "y", (F.pmod("h", F.lit(5)) != 0).alias("counts")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y in (0, 1):
                texts = [t for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if label == y]
                for i in range(0, len(texts), 200):
                    keys, n = np.unique(grams([w for t in texts[i:i + 200] for w in words_of(t)])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n * y), pa.array(n * (1 - y))], ["key", "toxic", "ordinary"])

    counted = (rows.where("counts").drop("counts").mapInArrow(count, "key long, toxic long, ordinary long")
               .groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow())
    columns = [counted.column(c).to_numpy() for c in ("key", "toxic", "ordinary")]
    if not len(columns[0]) or not columns[1].sum() or not columns[2].sum():
        return {"tables": None}
    tables = ratio_tables(*columns)
    shipped = docs.sparkSession.sparkContext.broadcast(tables)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(shipped.value)
        for batch in batches:
            found = evidence(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in found.T)], ["y", "x0", "x1", "x2"])

    held = rows.where("not counts").drop("counts").mapInArrow(weigh, "y int, x0 double, x1 double, x2 double").toArrow()
    y, x = held.column("y").to_numpy(), np.column_stack([held.column(f"x{i}").to_numpy() for i in range(3)])
    if len(set(y.tolist())) < 2:
        return {"tables": shipped, "curve": (np.array([1.0, 0.0, 0.0, 0.0]), np.array([0.01, 1.0, 1.0]))}
    return {"tables": shipped, "curve": fit_curve(x, y)}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``row`` (the input row), ``score`` in 0..1 and ``predicted`` (1 if score >= 0.5).

    Null and empty texts and texts without letters have evidence 0; without a model the
    score is 0.  Equal texts get equal scores, repeated rows stay.
    """
    shipped, curve = model["tables"], model.get("curve")

    def start():
        evidence = Evidence(shipped.value) if shipped else None

        def run(texts: list[str | None]) -> list[pa.Array]:
            if evidence is None:
                return [pa.array(np.zeros(len(texts)))]
            theta, scale = curve
            return [pa.array(1 / (1 + np.exp(-np.clip(evidence(texts) / scale @ theta[:-1] + theta[-1], -500, 500))))]

        return run

    return (with_scores(docs, text_col, start, [T.StructField("score", T.DoubleType())])
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Score every document; rows whose crc32(id) mod ``folds`` is 0 are held out of learning."""
    model = fit(docs, labels, train=F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds)) != 0)
    return (score(docs.select("doc_id", "text"), model)
            .select(F.col("row.doc_id").alias("doc_id"), "score", "predicted")
            .withColumn("held_out", id_crc("doc_id") % folds == 0)
            .select("doc_id", "held_out", "score", "predicted"))

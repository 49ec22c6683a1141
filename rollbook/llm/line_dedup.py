"""Line dedup with two Bloom filters: one of lines seen, one of lines seen twice.

A line's key is the line without ASCII white space at its ends, with A-Z lower-cased.  Each
task enters the keys of its documents: a key that the first filter has already goes into the
second.  The filters of two tasks add up to one in Spark: what either has, and in the second also
what both first ones have.  No key of two documents is missed; a few others are taken for one.

Only suspected keys are shuffled, as digests: exact counts confirm them and choose the
document that keeps the line.  The filters only save work, so their size does not change the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from rollbook.llm.base import materialise, packed_columns, pieces_of, release

#: White space, as bytes, that does not count at the ends of a line.
SPACE = b" \t\n\x0b\x0c\r"
#: Bits for each line that might be entered, probes for each key, and the most bits of a filter
#: (it is broadcast); with more lines more are suspected, and still judged exactly.
BITS, PROBES, MOST_BITS = 16, 2, 1 << 29
#: Bits of a segment, the unit in which filters are added up, filters added up at once, and how often.
SEGMENT, FAN_IN, TIMES = 1 << 19, 32, 2
#: A digest with more than this share of the suspects is joined by broadcast: at most 1 / HOT of them.
HOT = 0.001


def keys_of(text: bytes, least: int) -> list[bytes]:
    """The key of each line, empty where it has under ``least`` code points."""
    return [k if len(k) >= least and (k.isascii() or len(k.decode("utf-8", "replace")) >= least) else b""
            for k in (line.strip(SPACE) for line in text.lower().split(b"\n"))]


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def text_hash(column: str = "text") -> Column:
    """Parts rows of one id by their text."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions, a row for each hash: its low half, then steps of its odd high half."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def holds(packed_bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all bits of each row of positions are set."""
    return ((packed_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


def set_bits(packed_bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed_bits, at.ravel() >> 3, np.uint8(1) << (at.ravel() & 7).astype(np.uint8))


class Filters:
    """Keys seen and keys seen twice, in ``bits`` (a power of two) bits each."""

    def __init__(self, bits: int):
        self.bits = bits
        self.seen, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def enter(self, hashes: np.ndarray) -> None:
        """``hashes`` holds a key as often as documents have it."""
        kinds, counts = np.unique(hashes, return_counts=True)
        at = probes(kinds, self.bits)
        set_bits(self.twice, at[holds(self.seen, at) | (counts > 1)])
        set_bits(self.seen, at)


def added(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """(seen, twice) of several filters of a segment."""
    seen = twice = np.zeros(SEGMENT // 8, np.uint8)
    for one, two in parts:
        one, two = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
        twice = twice | two | (seen & one)
        seen = seen | one
    return seen.tobytes(), twice.tobytes()


def twice_seen(docs: DataFrame, text_col: str, least: int, bits: int) -> np.ndarray:
    """The filter of keys that at least two documents hold."""
    size = SEGMENT // 8

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(bits)
        for batch in batches:
            hashes: list[int] = []
            for text in batch.column(0).cast(pa.binary()):
                if text.is_valid:
                    hashes.extend(map(xxh3_64_intdigest, set(keys_of(text.as_py(), least)) - {b""}))
                if len(hashes) > 500_000:
                    filters.enter(np.array(hashes, np.uint64))
                    hashes = []
            filters.enter(np.array(hashes, np.uint64))
        task = TaskContext.get().partitionId()
        for i in range(bits // SEGMENT):
            one, two = (x[i * size:(i + 1) * size] for x in (filters.seen, filters.twice))
            if one.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task], pa.int32()),
                                                  pa.array([one.tobytes()], pa.binary()), pa.array([two.tobytes()], pa.binary())], ["segment", "part", "seen", "twice"])
        release()

    schema = "segment int, part int, seen binary, twice binary"

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        seen, twice = added(list(zip(rows.seen, rows.twice)))
        return pd.DataFrame({"segment": [rows.segment.iat[0]], "part": [rows.part.iat[0] // FAN_IN], "seen": [seen], "twice": [twice]})

    parts = docs.select(text_col).mapInArrow(build, schema)
    for _ in range(TIMES):
        parts = parts.groupBy("segment", F.floor(F.col("part") / FAN_IN)).applyInPandas(add, schema)
    out = np.zeros(bits // 8, np.uint8)
    # One row for each segment, together one filter of bounded size.
    for row in parts.groupBy("segment").applyInPandas(add, schema).select("segment", "twice").collect():
        out[row["segment"] * size:(row["segment"] + 1) * size] = np.frombuffer(row["twice"], np.uint8)
    return out


def filter_bits(docs: DataFrame, text_col: str = "text", most: int = MOST_BITS) -> int:
    """A power of two with about BITS bits for each line of ``docs``, within bounds."""
    lines = docs.agg(F.coalesce(F.sum(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"))) + 1), F.lit(0))).first()[0]
    return min(most, max(SEGMENT, 1 << (BITS * lines - 1).bit_length() if lines else 0))


def suspects(docs: DataFrame, twice: np.ndarray, bits: int, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, text_hash, digest) of the lines that the second filter holds, once for each document."""
    shipped = docs.sparkSession.sparkContext.broadcast(twice)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shipped.value
        for batch in batches:
            owners: list[int] = []
            keys: list[bytes] = []
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                if text.is_valid:
                    own = set(keys_of(text.as_py(), least)) - {b""}
                    owners.extend([i] * len(own))
                    keys.extend(own)
            hit = np.flatnonzero(holds(twice, probes(np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys)), bits)))
            rows = pa.array(np.array(owners, np.int64)[hit])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([digest(keys[i]) for i in hit.tolist()], pa.binary())],
                                             ["id", "text_hash", "digest"])
        release()

    schema = T.StructType([T.StructField("id", kind), T.StructField("text_hash", T.LongType()), T.StructField("digest", T.BinaryType())])
    return docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, copies: int = 3,
                  most_bits: int = MOST_BITS) -> DataFrame:
    """(id, text_hash, digests): for each document that loses lines, the digests of their keys."""
    bits = filter_bits(docs, text_col, most_bits)
    found = materialise(suspects(docs, twice_seen(docs, text_col, least, bits), bits, id_col, text_col, least), "suspects")
    kept = materialise(found.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= copies), "repeats")
    edge = HOT * found.count()
    # At most 1 / HOT digests have more than the share HOT of the suspects; the rest have no hot key.
    hot, cold = kept.where(F.col("n") > edge), kept.where(F.col("n") <= edge)
    loses = ~F.col("id").eqNullSafe(F.col("keeper"))
    lost = (found.join(F.broadcast(hot), "digest").where(loses).select("id", "text_hash", "digest")
            .unionByName(found.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest").where(loses).select("id", "text_hash", "digest")))
    return materialise(lost.groupBy("id", "text_hash").agg(F.collect_set("digest").alias("digests")), "dropped")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, copies: int = 3,
          most_bits: int = MOST_BITS, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, all by default), ``kept`` (the text without its dropped lines), ``n_lines`` and ``n_dropped``.

    Lines are parted by ``\\n``; keys of at least ``least`` code points in at least ``copies`` documents
    lose all their lines except those in the document with the largest id.  Every row is a
    document, so a repeated row counts again, and rows that share the largest id all keep the line.
    A null id is less than any other, and if only null ids hold a line it stays.  A null text
    counts as an empty one: one empty line, kept as the empty text.  An empty table gives no rows.
    A text is held whole in one task; other columns are passed on in ``row``, whatever their names.
    """
    lost = dropped_lines(docs, id_col, text_col, least, copies, most_bits)
    read = F.struct(F.col(f"`{text_col}`")).alias("read")
    source = docs.select(read, packed_columns(keep or docs.columns), F.col(f"`{id_col}`").alias("owner"), text_hash(text_col).alias("own_hash"))
    marked = source.join(lost, F.col("owner").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")), "left").select("read", "row", "digests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, text_col):
                texts = batch.column(0).field(text_col).cast(pa.binary()).fill_null(b"").to_pylist()
                kept, n_lines, n_dropped = [], [], []
                for text, digests in zip(texts, batch.column(2).to_pylist()):
                    n_lines.append(text.count(b"\n") + 1)
                    if digests:
                        gone = set(digests)
                        lines = [line for line, key in zip(text.split(b"\n"), keys_of(text, least)) if not key or digest(key) not in gone]
                        text, left = b"\n".join(lines), len(lines)
                        n_dropped.append(n_lines[-1] - left)
                    else:
                        n_dropped.append(0)
                    kept.append(text)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                                 ["row", "kept", "n_lines", "n_dropped"])
        release()

    schema = T.StructType([T.StructField("row", source.schema["row"].dataType, False), T.StructField("kept", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return marked.mapInArrow(run, schema)

"""Merkle manifest of a table, with a proof for each row found by pointer jumping.

Every row is a leaf.  The leaves of a group, in order, are hashed in runs of two until one
node, the group's subroot, remains; the subroots, in order of their groups, likewise give the
root of the table.  Trees are built in blocks of 2 ** LEVELS neighbours, so that a shuffle
serves many levels and no task holds more than a block at once.

A node first knows its sibling, that is the segment of the proof towards its parent.  Nodes
are then joined with the ancestors that their segment ends at, which doubles the distance
and appends the ancestor's segment, until the segments of the leaves end at the root.  A
segment is held as ``sides`` (a character for each step up: ``<`` the sibling stands on the
left, ``>`` on the right, ``-`` there is none) and ``path`` (the siblings' digests, 32 bytes each).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.base import id_crc, materialise, release

#: Levels of a tree that are built from one shuffle.
LEVELS = 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each as its UTF-8 byte count, ``:`` and its text; a null is ``-``."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, values)).cast("binary"), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined_digest(digests: list[bytes]) -> bytes:
    """The digest of a run of nodes: of their digests as lower-case hex text."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def folded(digest: bytes, sides: str, path: bytes) -> bytes:
    """The root that a digest and the proof of its place lead to."""
    at = 0
    for side in sides:
        if side == "-":
            digest = joined_digest([digest])
            continue
        other = path[at:at + 32]
        digest = joined_digest([other, digest] if side == "<" else [digest, other])
        at += 32
    return digest


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 on within ``grp`` in ``order``, and ``size``, the rows of ``grp``.

    A distributed sort by group and order, written, then one offset for each group in each
    partition: as many rows as there are partitions and groups.
    """
    placed = materialise(rows.orderBy("grp", *order).select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("mid")), "sorted")
    runs = placed.groupBy("grp", "pid").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("grp").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialise(runs.select("grp", "pid", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
                                   F.sum("n").over(Window.partitionBy("grp")).alias("size")), "runs")
    return placed.join(runs, ["grp", "pid"]).withColumn("idx", F.col("mid") + F.col("shift")).drop("pid", "mid", "shift")


def _climb(base: int, levels: int):
    """Task function: the nodes of each block, with their siblings, and the block's top node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            flat, ends = items.flatten(), items.offsets.to_numpy() - items.offsets[0].as_py()
            at, digests = flat.field("idx").to_numpy(), flat.field("digest").to_pylist()
            out: dict[str, list] = {k: [] for k in ("grp", "height", "level", "idx", "sides", "path", "top")}
            take: list[np.ndarray] = []

            def add(grp, height, level, idx, sides, path, top, rows):
                for k, v in zip(out, ([grp] * len(idx), [height] * len(idx), [level] * len(idx), idx, sides, path, top)):
                    out[k].extend(v)
                take.append(rows)

            for i, (grp, block, height) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "height")))):
                order = ends[i] + np.argsort(at[ends[i]:ends[i + 1]])
                nodes, first = [digests[j] for j in order.tolist()], block << levels
                none = np.full(len(nodes), -1)
                steps = min(levels, height - base)
                if steps == 0:  # a lone leaf is its group's root and has no sibling
                    add(grp, height, base, [first], [""], [b""], [None], order)
                for step in range(steps):
                    n = len(nodes)
                    other = [j ^ 1 for j in range(n)]
                    add(grp, height, base + step, range(first, first + n), ["-" if o >= n else "<" if o < j else ">" for j, o in enumerate(other)],
                        [b"" if o >= n else nodes[o] for o in other], [None] * n, order if base + step == 0 else none[:n])
                    nodes, first = [joined_digest(nodes[j:j + 2]) for j in range(0, n, 2)], first >> 1
                add(grp, height, base + steps, [first], [""], [b""], nodes, none[:1])
            columns = [pa.array(out["grp"], pa.string()), pa.array(out["height"], pa.int32()), pa.array(out["level"], pa.int32()), pa.array(out["idx"], pa.int64()),
                       pa.array(out["sides"], pa.string()), pa.array(out["path"], pa.binary()), pa.array(out["top"], pa.binary())]
            if base == 0:
                rows = np.concatenate(take) if take else np.empty(0, np.int64)
                columns.append(flat.field("row").take(pa.array(rows, pa.int64(), mask=rows < 0)))
            yield pa.RecordBatch.from_arrays(columns, [*out, *(["row"] if base == 0 else [])])
        release()

    return run


def trees(rows: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, int]:
    """(nodes, roots, height of the highest tree) of the trees over ``rows`` (grp, idx, size, digest, row).

    nodes: grp, height, level, idx, sides, path, row (of leaves); each with its step to the parent.
    roots: grp, digest.
    """
    now = rows.select("grp", "idx", "digest", "row", F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0).cast("int").alias("height"))
    highest = now.agg(F.coalesce(F.max("height"), F.lit(0))).first()[0]
    row_type = now.schema["row"].dataType.simpleString()
    schema = "grp string, height int, level int, idx long, sides string, path binary, top binary"
    built, base = [], 0
    while True:
        item = F.struct("idx", "digest", *(["row"] if base == 0 else []))
        blocks = now.groupBy("grp", F.shiftright("idx", levels).alias("block"), "height").agg(F.collect_list(item).alias("items"))
        made = materialise(blocks.mapInArrow(_climb(base, levels), schema + (f", row {row_type}" if base == 0 else "")), "nodes")
        built.append(made if base == 0 else made.withColumn("row", F.lit(None).cast(row_type)))
        base += levels
        if base >= highest:
            break
        now = made.where((F.col("top").isNotNull()) & (F.col("level") == base) & (F.col("level") < F.col("height"))).select("grp", "idx", F.col("top").alias("digest"), "height")
    every = reduce(DataFrame.unionByName, built)
    return every.where("top is null").drop("top"), every.where("top is not null and level = height").select("grp", F.col("top").alias("digest")), highest


def jumped(nodes: DataFrame, highest: int) -> DataFrame:
    """The leaves among ``nodes``, with the segments of their whole way to the root of their tree.

    With each round the distance to the ancestor doubles, so only nodes at levels that are a
    multiple of it are still asked for; the others end.
    """
    reach = 1
    while reach < highest:
        below = nodes.where(F.col("level") % (2 * reach) == 0)
        above = nodes.where(F.col("level") % (2 * reach) == reach).select(
            F.col("grp").alias("up_grp"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), F.col("sides").alias("up_sides"), F.col("path").alias("up_path"))
        meet = ((F.col("grp") == F.col("up_grp")) & (F.col("level") + reach == F.col("up_level")) & (F.shiftright("idx", reach) == F.col("up_idx")))
        nodes = materialise(below.join(above, meet, "left").select(
            "grp", "height", "level", "idx", F.concat("sides", F.coalesce("up_sides", F.lit(""))).alias("sides"),
            F.concat("path", F.coalesce("up_path", F.lit("").cast("binary"))).alias("path"), "row"), "jump")
        reach *= 2
    return nodes.where("level = 0 and row is not null")


def proofs(rows: DataFrame, order: list[str], levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """((grp, row, sides, path) of each of ``rows`` (grp, digest, row), (grp, digest) of each tree's root)."""
    nodes, roots, highest = trees(numbered(rows, order), levels)
    return jumped(nodes, highest).select("grp", "row", "sides", "path"), roots


def _refolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [folded(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("claimed", "sides", "path")))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "folded"])


def manifest(docs: DataFrame, claimed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row for each document: doc_id, leaf, subroot, root, sides, path, proof_sha256, folded_root, verified.

    A tree for each ``lang`` with its leaves by doc_id, and one over the langs.  ``claimed`` is the
    n_chars that verification is given instead of the true one (default: the same); ``folded_root`` is
    recomputed from the leaf with it and the proof, and ``verified`` says whether that is the root.

    Nulls in any column are hashed as ``-``; the null lang and null ids come first.  Documents of one id
    stand by their leaf, so equal rows have equal leaves and neighbouring places.  Texts are hashed
    where they are read and never shuffled, so their length does not matter; the empty text differs
    from null.  Other columns are not hashed and may have any name.  An empty table gives no rows.
    """
    fields = [F.col(c) for c in FIELDS]
    told = [claimed if c == "n_chars" and claimed is not None else F.col(c) for c in FIELDS]
    leaf = leaf_digest(fields)
    same = reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(fields, told)])
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    hashed = docs.select(grp.alias("grp"), "doc_id", leaf.alias("digest"), F.when(~same, leaf_digest(told)).alias("claim"))
    rows = materialise(hashed, "leaves").select("grp", "digest", F.struct("doc_id", F.col("digest").alias("leaf"), F.coalesce("claim", "digest").alias("claimed")).alias("row"))
    leaves, subroots = proofs(rows, ["row.doc_id", "digest"], levels)
    upper, root = proofs(subroots.select(F.lit("").alias("grp"), "digest", F.struct("grp", F.col("digest").alias("subroot")).alias("row")), ["row.grp"], levels)
    # One row for each lang.
    upper = materialise(upper.join(root.select("grp", F.col("digest").alias("root")), "grp").select(
        "row.grp", "row.subroot", "root", F.col("sides").alias("up_sides"), F.col("path").alias("up_path")), "subroots")
    whole = leaves.join(upper, "grp").select("row.*", "subroot", "root", F.concat("sides", "up_sides").alias("sides"), F.concat("path", "up_path").alias("path"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = whole.mapInArrow(_refolded, f"doc_id {id_type}, leaf binary, claimed binary, subroot binary, root binary, sides string, path binary, folded binary")
    return out.select("doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), "sides", "path",
                      F.sha2(_hex(F.col("path")).cast("binary"), 256).alias("proof_sha256"), _hex(F.col("folded")).alias("folded_root"),
                      (F.col("folded") == F.col("root")).alias("verified"))


def tampered_n_chars(divisor: int = 7) -> Column:
    """n_chars, one larger where ``divisor`` divides the crc32 of the id as text (of a null id: of the empty text)."""
    return F.when(id_crc("doc_id") % divisor == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))

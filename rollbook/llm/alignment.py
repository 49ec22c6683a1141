"""Cross-tokenizer alignment: two tokenizations of a text, cut where tokens of both end.

A text is parted at spaces behind other characters.  No token of either tokenizer crosses
such a place, so each different part is tokenized and aligned once in a task's memory, and
a document is put together from its parts.

A group of one token on each side, where the second is the one with the first's bytes (a
map prepared from the two vocabularies), is regular: the first id alone says which pair it
is, so its count goes into a vector as long as the vocabulary.  Only pairs of other groups
are shuffled.  Counts of the commonest of these are broadcast (a fixed number), all others joined.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.base import materialise, packed_columns, pieces_of, release

#: The public tokenizer files; parameters of every function that needs them.
BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Parts kept in a task's memory, parts tokenized at once, and pair counts that are broadcast.
CACHE, AT_ONCE, FREQUENT = 400_000, 50_000, 200_000
#: A place that no token crosses: a space, not at the end, behind a character that is neither white space nor the marker.
PLACE = re.compile(r"(?<=[^\s▁]) (?=[\s\S])")
MARK = "▁"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1
    characters for themselves, the other bytes in order for the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def surfaces_a(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        loaded = json.load(f)
    letters = byte_letters()
    out = [b""] * (1 + max([*loaded["model"]["vocab"].values(), *(t["id"] for t in loaded["added_tokens"])]))
    for token, i in loaded["model"]["vocab"].items():
        out[i] = bytes(letters[c] for c in token)
    return out


def surfaces_b(path: str) -> list[bytes]:
    """The bytes of each id of a piece model: the marker is a space, byte pieces their byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode("utf-8") for i, p in enumerate(pieces)]


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each id of ``a`` the first id of ``b`` with the same bytes, -1 where there is none."""
    first: dict[bytes, int] = {}
    for i, surface in enumerate(b):
        first.setdefault(surface, i)
    return np.array([first.get(s, -1) if s else -1 for s in a], np.int64)


class Aligner:
    """Tokenizes and aligns texts; remembers the parts it has seen."""

    def __init__(self, a_path: str, b_path: str, a: list[bytes], b: list[bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(a_path)
        self.first.encode_special_tokens = True  # their strings in a text are ordinary text
        self.second = SentencePieceProcessor(model_file=b_path)
        self.a, self.b = a, b
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        # Ids as text with what may follow: inside a group, behind its first half; behind it, behind a part.
        self.names = [f"{i}{c}" for i in range(len(a)) for c in ",|"] + [f"{i}{c}" for i in range(len(b)) for c in ",;\n"]
        self.clear()

    def clear(self) -> None:
        #: For each part its place in what follows: tokens of both sides, pairs (``codes`` from ``begin``
        #: on), groups as text; a part that is not given back byte by byte has no groups.
        self.at: dict[str, int] = {}
        self.n_a = self.n_b = self.n_pairs = self.begin = self.codes = np.empty(0, np.int64)
        self.groups: list[str | None] = []

    def learn(self, parts: list[str]) -> None:
        """Tokenize and align parts that are not known yet, laid one behind the other."""
        ids_a = [e.ids for e in self.first.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        ids_b = self.second.encode(parts, num_threads=1)
        na, nb = (np.fromiter(map(len, x), np.int64, len(parts)) for x in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((ids_a, na), (ids_b, nb)))
        raw = [(" " + p).encode("utf-8", "surrogatepass") for p in parts]
        ok = np.ones(len(parts), bool)
        if not all(self.read(surface, flat.tolist()) == b"".join(raw) for surface, flat in ((self.a, flat_a), (self.b, flat_b))):
            ok = np.array([self.read(self.a, x) == r == self.read(self.b, y) for x, y, r in zip(ids_a, ids_b, raw)], bool)
            flat_a, flat_b = flat_a[np.repeat(ok, na)], flat_b[np.repeat(ok, nb)]
        part = np.repeat(np.arange(len(parts)), np.where(ok, na, 0))
        _, last_a, last_b = np.intersect1d(np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b]), assume_unique=True, return_indices=True)
        # Both sides' tokens in the order of the text of groups.
        n_groups, i, j = len(last_a), np.arange(len(flat_a)), np.arange(len(flat_b))
        group_a, group_b = np.searchsorted(last_a, i), np.searchsorted(last_b, j)
        ends_a, ends_b = np.zeros(len(i), np.int64), np.zeros(len(j), np.int64)
        ends_a[last_a], ends_b[last_b] = 1, 1
        ends_b[last_b[np.flatnonzero(np.diff(part[last_a], append=-1))]] = 2
        order = np.empty(len(i) + len(j), np.int64)
        order[i + np.append(0, last_b + 1)[group_a]] = 2 * flat_a + ends_a
        order[j + last_a[group_b] + 1 if n_groups else j] = 2 * len(self.a) + 3 * flat_b + ends_b
        told = iter("".join(map(self.names.__getitem__, order.tolist())).split("\n"))
        self.at.update(zip(parts, range(len(self.groups), len(self.groups) + len(parts))))
        self.groups.extend(next(told) if fine else None for fine in ok.tolist())
        n = np.bincount(part[last_a], minlength=len(parts))
        self.begin = np.append(self.begin, len(self.codes) + np.cumsum(n) - n)
        self.n_a, self.n_b, self.n_pairs = np.append(self.n_a, na), np.append(self.n_b, nb), np.append(self.n_pairs, n)
        self.codes = np.append(self.codes, flat_a[last_a] * len(self.b) + flat_b[last_b])

    @staticmethod
    def read(surface: list[bytes], ids: list[int]) -> bytes:
        return b"".join(map(surface.__getitem__, ids))

    def align(self, texts: list[str | None]) -> list[tuple[int, int, str, np.ndarray]]:
        """Of each text the tokens of both sides, the groups as text and the pair of each group."""
        parted = [PLACE.split(t) if t else [] for t in texts]
        if len(self.at) > CACHE:
            self.clear()
        new = list(set().union(*parted).difference(self.at))
        for begin in range(0, len(new), AT_ONCE):
            self.learn(new[begin:begin + AT_ONCE])
        out = []
        none = (0, 0, "", np.empty(0, np.int64))
        for parts in parted:
            at = list(map(self.at.__getitem__, parts))
            groups = list(map(self.groups.__getitem__, at))
            if not at or None in groups:
                out.append(none)
                continue
            n = self.n_pairs[at]
            total = int(n.sum())
            codes = self.codes[np.repeat(self.begin[at] - np.cumsum(n) + n, n) + np.arange(total)]
            out.append((int(self.n_a[at].sum()), int(self.n_b[at].sum()), ";".join(groups), codes))
        return out


def aligned(docs: DataFrame, text_col: str, keep: list[str], paths: tuple[str, str], shipped) -> DataFrame:
    """``id``, ``row``, n_a, n_b, n_groups, groups_sha256, and the document's different pairs: codes, times."""
    source = docs.select(F.struct(F.col(f"`{text_col}`")).alias("read"), packed_columns(keep), F.monotonically_increasing_id().alias("id"))
    names = ["id", "row", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, _ = shipped.value
        aligner = Aligner(*paths, a, b)
        for whole in batches:
            for batch in pieces_of(whole, text_col):
                found = aligner.align(batch.column(0).field(text_col).to_pylist())
                kinds = [np.unique(x[3], return_counts=True) for x in found]
                offsets = pa.array(np.cumsum([0, *(len(k) for k, _ in kinds)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([k[i] for k in kinds]) if kinds else [], pa.int64())) for i in (0, 1)]
                numbers = [pa.array([f(x) for x in found], pa.int64()) for f in (lambda x: x[0], lambda x: x[1], lambda x: len(x[3]))]
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), *numbers, pa.array([sha256(x[2].encode()).hexdigest() if x[2] else "" for x in found], pa.string()), *lists], names)
        release()

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("row", source.schema["row"].dataType, False),
                           *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups")),
                           T.StructField("groups_sha256", T.StringType()), T.StructField("codes", longs), T.StructField("times", longs)])
    return source.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, shipped) -> tuple[np.ndarray, DataFrame]:
    """(count of the regular pair of each first id, (code, c) of all other pairs) over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, b, same = shipped.value
        vector, others = np.zeros(len(same), np.int64), Counter()

        def table(first, code, c) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(code, pa.int64()), pa.array(c, pa.int64())], ["first", "code", "c"])

        for batch in batches:
            codes, times = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            first = codes // len(b)
            regular = same[first] == codes % len(b)
            np.add.at(vector, first[regular], times[regular])
            kinds, which = np.unique(codes[~regular], return_inverse=True)
            others.update(dict(zip(kinds.tolist(), np.bincount(which, times[~regular], len(kinds)).astype(np.int64).tolist())))
            if len(others) > 1_000_000:
                yield table([None] * len(others), list(others), list(others.values()))
                others.clear()
        yield table([None] * len(others), list(others), list(others.values()))
        used = np.flatnonzero(vector)
        yield table(used, [None] * len(used), vector[used])
        release()

    counted = materialise(rows.select("codes", "times").mapInArrow(run, "first int, code long, c long"), "pair-parts")
    regular = np.zeros(len(shipped.value[2]), np.int64)
    for first, c in counted.where("first is not null").groupBy("first").agg(F.sum("c")).collect():  # no more rows than the vocabulary
        regular[first] = c
    return regular, materialise(counted.where("code is not null").groupBy("code").agg(F.sum("c").alias("c")), "pairs")


def alignment(docs: DataFrame, text_col: str = "text", a_path: str = BYTE_BPE, b_path: str = PIECES, frequent: int = FREQUENT,
              keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, all by default), n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs``.

    The first tokenizer reads a space and the text, the second the text, before which it puts a
    space itself.  A link joins the tokens that end a group.  A pair of ids counts as often as
    the table links it; ``n_best`` counts links whose pair is the commonest of its second id (all
    of equally common ones), ``count_sum`` adds up the counts of the pairs of the links.

    A text that is null or empty, or that either tokenizer does not give back byte by byte, has
    no tokens: zeros and an empty ``groups_sha256``.  Repeated rows stay and count again.  Other
    columns are passed on in ``row``, whatever their names.  A text is tokenized part by part; one
    without spaces is a single part, held whole in one task.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    a, b = surfaces_a(a_path), surfaces_b(b_path)
    if any(b" " in s.lstrip(b" ") for s in b):
        raise ValueError("a piece holds a space behind another character: parts of a text are then not independent")
    same = identity_map(a, b)
    shipped = spark.sparkContext.broadcast((a, b, same))
    rows = materialise(aligned(docs, text_col, keep or docs.columns, (a_path, b_path), shipped), "aligned")
    regular, pairs = pair_counts(rows, shipped)
    # Of each second id the largest count of a pair: as long as the vocabulary.
    best = np.zeros(len(b), np.int64)
    np.maximum.at(best, same[same >= 0], regular[same >= 0])
    for second, c in pairs.groupBy((F.col("code") % len(b)).alias("second")).agg(F.max("c")).collect():
        best[second] = max(best[second], c)
    top = pairs.orderBy(F.col("c").desc(), "code").limit(frequent).toArrow()
    codes = top.column("code").to_numpy()
    order = np.argsort(codes)
    counts = spark.sparkContext.broadcast((same, regular, best, codes[order], top.column("c").to_numpy()[order]))
    n_second = len(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, regular, best, known, known_c = counts.value
        known, known_c = np.append(known, -1), np.append(known_c, 0)
        order = np.argsort(known)
        known, known_c = known[order], known_c[order]
        for batch in batches:
            lists = batch.column(1)
            n = np.diff(lists.offsets.to_numpy())
            code, times = (batch.column(i).flatten().to_numpy() for i in (1, 2))
            owner = np.repeat(np.arange(batch.num_rows), n)
            first, second = code // n_second, code % n_second
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            is_regular, is_known = same[first] == second, known[at] == code
            c = np.where(is_regular, regular[first], np.where(is_known, known_c[at], 0))
            told = is_regular | is_known
            n_best = np.bincount(owner, np.where(told & (c == best[second]), times, 0), batch.num_rows).astype(np.int64)
            # Sums in whole numbers: they may exceed what a double holds exactly.
            sums = np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, owner, c * times)
            ids = batch.column(0)
            empty = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_best), pa.array(sums), empty, empty], ["id", "n_best", "count_sum", "code", "times"])
            rest = np.flatnonzero(~told)
            if len(rest):
                none = pa.nulls(len(rest), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner[rest])), none, none, pa.array(code[rest]), pa.array(times[rest])], ["id", "n_best", "count_sum", "code", "times"])
        release()

    judged = materialise(rows.select("id", "codes", "times").mapInArrow(run, "id long, n_best long, count_sum long, code long, times long"), "judged")
    bests = spark.createDataFrame([(i, int(c)) for i, c in enumerate(best)], "second long, best long")
    rare = (judged.where("code is not null").join(pairs, "code").join(F.broadcast(bests), F.col("code") % n_second == F.col("second"))
            .select("id", F.when(F.col("c") == F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("c") * F.col("times")).alias("count_sum")))
    sums = (judged.where("code is null").select("id", "n_best", "count_sum").unionByName(rare)
            .groupBy("id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    return rows.select("id", "row", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "id").select(
        "row", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")

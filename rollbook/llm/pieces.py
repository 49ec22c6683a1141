"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their log scores come from a public model file; nothing is trained.
A text gets the dummy space, spaces become the marker U+2581, and the best path has
the largest sum of scores.  A character that no path covers is spelt in byte pieces.
Decoding joins pieces, turns the markers into spaces again and drops the dummy.

All new segments of a batch are cut together: the trie is walked for every start
position in step, then the best paths are filled in by position from the segments'
beginnings, both with numpy.  A long segment (a text without spaces) is walked window by window,
so that its matches are never held at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.base import with_scores

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 400_000
#: Characters cut together, of a segment that is cut on its own, and of its windows.
TOGETHER, ALONE, STRETCH = 1_000_000, 200, 100_000
#: The public model file; a parameter of every function that needs one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def load_pieces(path: str = MODEL) -> dict:
    """Pieces, log scores, the ids of the byte pieces and the id of the unknown piece."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids])
    return {
        "pieces": [model.id_to_piece(i) for i in ids],
        "scores": log_scores(np.array([model.get_score(i) for i in ids]), plain),
        "plain": plain,
        "bytes": {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)},
        "unknown": model.unk_id(),
    }


def log_scores(scores: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """The file's scores if they are log probabilities.  A merge vocabulary has whole numbers
    instead, which only rank its pieces; the piece of rank r then gets the log probability of
    Zipf's law, in proportion to 1 / (r + 1), equal scores ranked by id."""
    if not plain.any() or (scores[plain] != np.round(scores[plain])).any():
        return scores
    order = np.flatnonzero(plain)
    order = order[np.argsort(-scores[order], kind="stable")]
    out = np.zeros(len(scores))
    out[order] = -np.log(np.arange(len(order)) + 1) - np.log((1 / (np.arange(len(order)) + 1)).sum())
    return out.astype(np.float32).astype(float)


class DoubleArray:
    """A trie in two arrays: the child of state s by code c is base[s] + c, if check of that is s."""

    def __init__(self, base: np.ndarray, check: np.ndarray, value: np.ndarray):
        self.base, self.check, self.value = base, check, value

    @classmethod
    def build(cls, keys: list[list[int]], values: list[int], alphabet: int) -> DoubleArray:
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in zip(keys, values):
            at = 0
            for code in key:
                if code not in tree[at]:
                    tree[at][code] = len(tree)
                    tree.append({})
                at = tree[at][code]
            ends[at] = value
        size = 4 * len(tree) + 5 * alphabet + 2 * 4096  # a window of bases and all codes fit behind the last node
        base_of = np.zeros(size, np.int64)
        check = np.full(size, -1, np.int64)
        value = np.full(size, -1, np.int64)
        free = np.ones(size, bool)
        free[0] = False
        low, queue = 1, [(0, 0)]
        for node, state in queue:
            if node in ends:
                value[state] = ends[node]
            if not tree[node]:
                continue
            codes = sorted(tree[node])
            low += int(free[low:].argmax())
            base = cls._place(free, low, codes)
            base_of[state] = base
            for code in codes:
                free[base + code] = False
                check[base + code] = state
                queue.append((tree[node][code], base + code))
        last = int(np.flatnonzero(~free)[-1]) + alphabet + 2
        return cls(base_of[:last], check[:last], value[:last])

    @staticmethod
    def _place(free: np.ndarray, low: int, codes: list[int]) -> int:
        """The least base at which the slots of all codes are free, tried many at a time."""
        while True:
            bases = low + np.flatnonzero(free[low:low + 4096]) - codes[0]
            bases = bases[bases >= 1]
            for code in codes[1:]:
                bases = bases[free[bases + code]]
            if len(bases):
                return int(bases[0])
            low += 4096

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each state, -1 where there is none; code 0 has no child."""
        at = self.base[states] + codes
        at[at >= len(self.check)] = 0
        return np.where((codes > 0) & (self.base[states] > 0) & (self.check[at] == states), at, -1)


def prepare(loaded: dict) -> dict:
    """What the tasks need, as plain data for a broadcast: trie, scores and byte strings."""
    plain = np.flatnonzero(loaded["plain"])
    pieces, scores = [loaded["pieces"][i] for i in plain], loaded["scores"]
    letters = sorted({ord(c) for p in pieces for c in p})
    code = {c: i + 1 for i, c in enumerate(letters)}
    trie = DoubleArray.build([[code[ord(c)] for c in p] for p in pieces], plain.tolist(), len(letters) + 1)
    surface = [p.replace(MARK, " ").encode("utf-8") if ok else b"" for p, ok in zip(loaded["pieces"], loaded["plain"])]
    for byte, i in loaded["bytes"].items():
        surface[i] = bytes([byte])
    surface[loaded["unknown"]] = " ⁇ ".encode()
    # A cut before each run of markers loses no path if no piece has a marker behind another
    # character; a line end that is in no piece is spelt in bytes and so always stands alone.
    inner = any(MARK in p.lstrip(MARK) for p in pieces)
    line = "" if "\n" in {c for p in pieces for c in p} else "\n"
    return {
        "base": trie.base, "check": trie.check, "value": trie.value, "letters": np.array(letters or [0], np.uint32),
        "scores": scores, "reach": max(map(len, pieces), default=1), "bytes": loaded["bytes"], "unknown": loaded["unknown"], "surface": surface,
        "unknown_score": float(scores[plain].min() if len(plain) else 0.0) - UNKNOWN_PENALTY,
        "segment": r"(?s).+" if inner else f"{MARK}*[^{MARK}{line}]+|{MARK}+" + (f"|{line}+" if line else ""),
    }


class Model:
    """Encoder and decoder over prepared data."""

    def __init__(self, data: dict):
        self.trie = DoubleArray(data["base"], data["check"], data["value"])
        self.letters, self.scores, self.surface = data["letters"], data["scores"], data["surface"]
        self.bytes, self.unknown, self.unknown_score = data["bytes"], data["unknown"], data["unknown_score"]
        self.segment, self.reach = re.compile(data["segment"]), data["reach"]

    def codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + 1, 0), points

    def matches(self, codes: np.ndarray, stop: np.ndarray, n: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces from the first ``n`` places on, each ending by ``stop`` of its start;
        a character that is no piece counts as piece -1.  The trie is walked from all starts in step."""
        n = len(codes) if n is None else n
        starts, states, depth = np.arange(n), np.zeros(n, np.int64), 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.zeros(n, bool)
        while len(starts):
            inside = starts + depth < stop[starts]
            starts, states = starts[inside], states[inside]
            states = self.trie.step(states, codes[starts + depth])
            alive = states >= 0
            starts, states, depth = starts[alive], states[alive], depth + 1
            value = self.trie.value[states]
            hit = value >= 0
            found.append((starts[hit], starts[hit] + depth, value[hit]))
            if depth == 1:
                single[starts[hit]] = True
        missing = np.flatnonzero(~single)
        found.append((missing, missing + 1, np.full(len(missing), -1)))
        start, end, piece = (np.concatenate(x) for x in zip(*found))
        return start, end, piece

    def cut_alone(self, segment: str) -> bytes:
        """The best path of one long segment: matches of a window at a time, best scores of a window and
        a piece's length, and for each place the last piece of its best path."""
        n, reach = len(segment), self.reach
        last_piece, last_size = np.empty(n + 1, np.int32), np.empty(n + 1, np.int32)
        best, pieces, sizes = [0.0], [0], [0]
        for begin in range(0, n, STRETCH):
            size = min(STRETCH, n - begin)
            codes, _ = self.codes(segment[begin:begin + size + reach])
            start, end, piece = self.matches(codes, np.full(size, len(codes)), size)
            order = np.argsort(start, kind="stable")
            score = np.where(piece >= 0, self.scores[piece], self.unknown_score)
            more = size + reach + 1 - len(best)
            best, pieces, sizes = best + [-np.inf] * more, pieces + [0] * more, sizes + [0] * more
            for a, b, p, x in zip(*(v[order].tolist() for v in (start, end, piece, score))):
                total = best[a] + x
                if total > best[b]:  # the first of equals has the longest piece
                    best[b], pieces[b], sizes[b] = total, p, b - a
            last_piece[begin + 1:begin + size + 1], last_size[begin + 1:begin + size + 1] = pieces[1:size + 1], sizes[1:size + 1]
            best, pieces, sizes = best[size:], pieces[size:], sizes[size:]
        path: list[int] = []
        at = n
        while at:
            p = int(last_piece[at])
            path.extend([p] if p >= 0 else reversed(self.spell(segment[at - 1])))
            at -= int(last_size[at])
        return np.array(path[::-1], np.int32).tobytes()

    def cut(self, segments: list[str]) -> list[bytes]:
        """The best path of each segment, as the bytes of its int32 ids."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        ends = np.cumsum(lengths)
        begins = ends - lengths
        codes, points = self.codes("".join(segments))
        n = len(codes)
        stop = np.repeat(ends, lengths)
        start, end, piece = self.matches(codes, stop)
        score = np.where(piece >= 0, self.scores[piece], self.unknown_score)
        # Fill the best score of each position, by its distance from the segment's beginning.
        first = np.repeat(begins, lengths)
        reach = end - first[start]
        order = np.lexsort((start, end, reach))
        start, end, piece, score, reach = start[order], end[order], piece[order], score[order], reach[order]
        best = np.zeros(n + len(segments))
        node = np.arange(n) + np.repeat(np.arange(len(segments)), lengths)  # each segment has a node before its first character
        start_node, end_node = node[start], node[end - 1] + 1
        back = np.zeros(n + len(segments), np.int64)
        rounds = np.flatnonzero(np.diff(reach, prepend=-1, append=-1))
        for a, b in zip(rounds[:-1], rounds[1:]):
            total = best[start_node[a:b]] + score[a:b]
            group = np.flatnonzero(np.diff(end_node[a:b], prepend=-1))
            top = np.maximum.reduceat(total, group)
            # The first of equals has the longest piece.
            is_top = np.flatnonzero(total == np.repeat(top, np.diff(np.append(group, b - a))))
            nodes, which = np.unique(end_node[a:b][is_top], return_index=True)
            best[nodes], back[nodes] = top, a + is_top[which]
        # Walk all paths back together.
        at = begins + lengths + np.arange(len(segments))
        root = begins + np.arange(len(segments))
        owner = np.arange(len(segments))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        live = at > root
        at, root, owner = at[live], root[live], owner[live]
        while len(at):
            edge = back[at]
            steps.append((owner, edge))
            at = start_node[edge]
            live = at > root
            at, root, owner = at[live], root[live], owner[live]
        if not steps:
            return [b""] * len(segments)
        owners, edges = (np.concatenate(x) for x in zip(*steps))
        turn = np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps])
        order = np.lexsort((-turn, owners))
        owners, edges = owners[order], edges[order]
        ids = piece[edges].astype(np.int32)
        counts = np.bincount(owners, minlength=len(segments))
        plain = np.bincount(owners, ids < 0, len(segments)) == 0
        cuts = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for i, ok in enumerate(plain):
            part = ids[cuts[i]:cuts[i + 1]]
            if not ok:
                spelt: list[int] = []
                for p, e in zip(part.tolist(), edges[cuts[i]:cuts[i + 1]].tolist()):
                    spelt.extend([p] if p >= 0 else self.spell(chr(points[start[e]])))
                part = np.array(spelt, np.int32)
            out.append(part.tobytes())
        return out

    def spell(self, character: str) -> list[int]:
        raw = character.encode("utf-8", "replace")
        return [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown]

    def encoder(self) -> Callable[[list], list[np.ndarray]]:
        cache: dict[str, bytes] = {}

        def learn(new: list[str]) -> None:
            held: list[str] = []
            size = 0
            for segment in new:
                held.append(segment)
                size += len(segment)
                if size >= TOGETHER:
                    cache.update(zip(held, self.cut(held)))
                    held, size = [], 0
            if held:
                cache.update(zip(held, self.cut(held)))

        def encode(texts: list[str | None]) -> list[np.ndarray]:
            parted = [self.segment.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
            if len(cache) > CACHE:
                cache.clear()
            new = sorted(set().union(*parted).difference(cache), key=len)
            alone = [s for s in new if len(s) > ALONE]
            learn(new[:len(new) - len(alone)])
            cache.update((s, self.cut_alone(s)) for s in alone)
            out = [np.frombuffer(b"".join(map(cache.__getitem__, segments)), np.int32) for segments in parted]
            for s in alone:  # not worth their room
                del cache[s]
            return out

        return encode

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """``row``, ``ids`` (array of int), ``n_tokens`` and ``round_trip``: whether decoding the
    ids gives the text again (false only for texts that hold the marker character itself).

    A null text has null ids, an empty one no ids.  Repeated rows stay.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(prepare(load_pieces(model_path)))

    def start():
        model = Model(shipped.value)
        cut = model.encoder()

        def run(texts: list[str | None]) -> list[pa.Array]:
            found = cut(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            nulls = pa.array([t is None for t in texts])
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=nulls) if len(texts) else pa.array([], pa.list_(pa.int32()))
            counts = pa.array([None if t is None else len(x) for t, x in zip(texts, found)], pa.int64())
            same = pa.array([None if t is None else model.decode(x) == t for t, x in zip(texts, found)], pa.bool_())
            return [lists, counts, same]

        return run

    return with_scores(docs, text_col, start, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
                                               T.StructField("round_trip", T.BooleanType())])


def decode(rows: DataFrame, ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """``row`` and ``text``, decoded from an array of ids; null ids give null.

    An id outside the vocabulary fails the row's task with an IndexError.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(prepare(load_pieces(model_path)))
    source = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType, False), T.StructField("text", T.StringType())])

    def run(batches):
        model = Model(shipped.value)
        for batch in batches:
            texts = [None if ids is None else model.decode(np.array(ids, np.int64)) for ids in batch.column(0).field(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return source.mapInArrow(run, schema)

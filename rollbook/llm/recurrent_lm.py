"""LM scoring with a gated recurrent network.

Tokens are words and one end for each text.  The network predicts the most frequent
words (the head) and one symbol for all others; a word outside the head then has its
share of their training counts.  The output softmax is factored into classes of words
of like frequency, small ones for common words.  The head grows with the corpus.  Training is truncated
backpropagation in numpy: every round learns from every training text, shared out over
tasks whose parameters Spark averages.  Scoring runs many texts in step, and each keeps its state from
window to window, so that a text of any length is scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.base import id_crc, materialise, release

END = b""
#: Words the network knows at least, and words whose counts are broadcast at least (all others
#: are joined).  The network knows every word that is seen sqrt(tokens) / RARITY times.
HEAD, FREQUENT, RARITY = 1000, 200_000, 16
STATE, EMBED = 16, 16
ROUNDS, LANES, WINDOW, RATE = 3, 32, 32, 0.01
#: Long streams are trained in more lanes, such that they still make LONG windows; tokens held
#: at once by a training task; parameters in a row of the average, and sets that a node of its tree adds up.
MOST_LANES, LONG, HELD_TOKENS, PART, TREE = 256, 100, 2_000_000, 16_384, 32
#: Tokens scored together in one task, and hidden states per block of the output layer.
BLOCK_TOKENS, BLOCK_STATES = 4_000_000, 200_000


def tokens_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space, then the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    words.append(END)
    return words


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; added up in each task, then by Spark."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens_of(text.as_py()))
                if len(counts) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


# -- the network ---------------------------------------------------------------------------

def layout(head: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each symbol, its place there, and the size of each class.

    Symbol 0 is all words outside the head, a class of its own; the head follows by falling
    frequency, cut into classes of equal sums of root frequencies, as many as that sum over all.  For
    that number of classes the softmax over a token's class then costs least: common words
    lie in classes of a few, rare ones in large classes that are seldom looked at.  ``counts``
    are those of the symbols; without them words are taken to follow Zipf's law.
    """
    counts = np.append(0.0, 1 / np.arange(1.0, head + 1)) if counts is None else np.asarray(counts, np.float64)
    roots = np.sqrt(counts[1:] / max(counts.sum(), 1e-300))
    classes = min(head, max(1, math.ceil(roots.sum())))
    middle = np.cumsum(roots) - roots / 2
    cut = np.minimum((middle / max(roots.sum(), 1e-300) * classes).astype(np.int64), classes - 1)
    of = np.append(0, 1 + np.unique(cut, return_inverse=True)[1]) if head else np.zeros(1, np.int64)
    sizes = np.bincount(of)
    return of, np.arange(head + 1) - (np.cumsum(sizes) - sizes)[of], sizes


def start_parameters(head: int, shape: tuple | None = None, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    classes = (shape or layout(head))[2]
    draw = lambda *size: (rng.standard_normal(size) * 0.1).astype(np.float32)
    return {"embed": draw(head + 2, EMBED), "wx": draw(EMBED, 3 * STATE), "wh": draw(STATE, 3 * STATE), "b": np.zeros(3 * STATE, np.float32),
            "wc": draw(STATE, len(classes)), "bc": np.zeros(len(classes), np.float32),
            "ww": draw(head + 1, STATE), "bw": np.zeros(head + 1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _cell(inputs: np.ndarray, state: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the gated unit; ``inputs`` holds the input's part of the three gates."""
    inner = state @ wh
    gates = _sigmoid(inputs[:, :2 * STATE] + inner[:, :2 * STATE])
    keep, reset = gates[:, :STATE], gates[:, STATE:]
    new = np.tanh(inputs[:, 2 * STATE:] + reset * inner[:, 2 * STATE:])
    return new + keep * (state - new), keep, reset, new, inner[:, 2 * STATE:]


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``x`` (overwritten) as exponentials, the sum of each row, and what was taken off each row.

    One number is taken off all rows; only where that leaves too little of a row, its own maximum.
    """
    off = x.max()
    low = x.max(1) < off - 60 if off - x.min() > 60 else None
    if low is not None and low.any():
        off = x.max(1, keepdims=True)
    x -= off
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype), np.broadcast_to(np.reshape(off, -1), len(x))


def _log_chosen(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log softmax of each row of ``x`` (overwritten) at its chosen column."""
    own = x[np.arange(len(x)), chosen]
    _, sums, off = _exponentials(x)
    return own - off - np.log(sums)


def _softmax_less(x: np.ndarray, chosen: np.ndarray, scale: np.float32) -> np.ndarray:
    """The gradient of the loss by ``x`` (overwritten): softmax, less one at the chosen column."""
    x, sums, _ = _exponentials(x)
    x *= (scale / sums)[:, None]
    x[np.arange(len(x)), chosen] -= scale
    return x


def _by_class(classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[slice, slice]]]:
    """Rows ordered by class, and for each class of several words that occurs its rows and members."""
    order = np.argsort(classes, kind="stable")
    cuts = np.searchsorted(classes[order], np.arange(len(sizes) + 1))
    begin = np.append(0, np.cumsum(sizes))
    occurring = np.flatnonzero((np.diff(cuts) > 0) & (sizes > 1))
    return order, ((slice(cuts[k], cuts[k + 1]), slice(begin[k], begin[k + 1])) for k in occurring.tolist())


def log_probabilities(p: dict, states: np.ndarray, symbols: np.ndarray, shape: tuple) -> np.ndarray:
    """Natural log of P(class | state) P(symbol | class, state) for each row."""
    of, place, sizes = shape
    order, groups = _by_class(of[symbols], sizes)
    states, symbols = states[order], symbols[order]
    logs = _log_chosen(states @ p["wc"] + p["bc"], of[symbols]).astype(np.float64)
    places = place[symbols]
    for rows, members in groups:
        logs[rows] += _log_chosen(states[rows] @ p["ww"][members].T + p["bw"][members], places[rows])
    out = np.empty(len(logs))
    out[order] = logs
    return out


def gradients(p: dict, symbols: np.ndarray, before: np.ndarray, fresh: np.ndarray, state: np.ndarray, shape: tuple) -> tuple[dict, np.ndarray]:
    """Gradients of the mean loss over one window (steps x lanes) and the state after it.

    ``before`` are the input symbols, ``fresh`` marks steps at which a text begins; the state
    comes from the window before and no gradient flows back into it.
    """
    of, place, sizes = shape
    steps, lanes = symbols.shape
    inputs = (p["embed"] @ p["wx"] + p["b"])[before] if before.size > len(p["embed"]) else p["embed"][before] @ p["wx"] + p["b"]
    kept, states = [], np.empty((steps, lanes, STATE), np.float32)
    for t in range(steps):
        entered = np.where(fresh[t][:, None], np.float32(0), state)
        state, keep, reset, new, inner = _cell(inputs[t], entered, p["wh"])
        kept.append((entered, keep, reset, new, inner))
        states[t] = state
    goal = symbols.reshape(-1)
    scale = np.float32(1 / len(goal))
    order, groups = _by_class(of[goal], sizes)
    flat, goal = states.reshape(-1, STATE)[order], goal[order]
    g = {"ww": np.zeros_like(p["ww"]), "bw": np.zeros_like(p["bw"]), "wh": np.zeros_like(p["wh"])}
    d = _softmax_less(flat @ p["wc"] + p["bc"], of[goal], scale)
    g["wc"], g["bc"] = flat.T @ d, d.sum(0)
    down, places = d @ p["wc"].T, place[goal]
    for rows, members in groups:
        w, h = p["ww"][members], flat[rows]
        d = _softmax_less(h @ w.T + p["bw"][members], places[rows], scale)
        g["ww"][members], g["bw"][members] = d.T @ h, d.sum(0)
        down[rows] += d @ w
    sent = np.empty_like(down)
    sent[order] = down
    down = sent.reshape(steps, lanes, STATE)
    carried, gates = np.zeros((lanes, STATE), np.float32), np.empty((steps, lanes, 3 * STATE), np.float32)
    back = np.empty((lanes, 3 * STATE), np.float32)
    for t in reversed(range(steps)):
        entered, keep, reset, new, inner = kept[t]
        total = down[t] + carried
        gate = gates[t]
        d_new = total * (1 - keep) * (1 - new * new)
        gate[:, :STATE] = total * (entered - new) * keep * (1 - keep)
        gate[:, STATE:2 * STATE] = d_new * inner * reset * (1 - reset)
        gate[:, 2 * STATE:] = d_new
        back[:, :2 * STATE] = gate[:, :2 * STATE]
        back[:, 2 * STATE:] = d_new * reset
        g["wh"] += entered.T @ back
        carried = np.where(fresh[t][:, None], np.float32(0), total * keep + back @ p["wh"].T)
    flat_gates, source = gates.reshape(-1, 3 * STATE), before.reshape(-1)
    # Gates added up for each input symbol: one product with each symbol's row, not with each token's.
    order = np.argsort(source, kind="stable")
    found, first = np.unique(source[order], return_index=True)
    sums = np.add.reduceat(flat_gates[order], first, 0)
    g["b"] = sums.sum(0)
    g["wx"] = p["embed"][found].T @ sums
    g["embed"] = np.zeros_like(p["embed"])
    g["embed"][found] = sums @ p["wx"].T
    return g, state


def train(p: dict, texts: list[np.ndarray], rate: float, shape: tuple | None = None) -> dict:
    """One pass of truncated backpropagation (Adam) over texts laid end to end in lanes.

    Every token is learnt from; the first few come again where the lanes need filling.  Rows
    of the tables of words that a window does not touch keep their value and their averages.
    """
    head = len(p["embed"]) - 2
    shape = shape or layout(head)
    if not texts:
        return p
    of, _, sizes = shape
    stream = np.concatenate(texts)
    first = np.zeros(len(stream), bool)
    first[np.cumsum([0, *map(len, texts[:-1])])] = True
    source = np.where(first, head + 1, np.roll(stream, 1))
    lanes = max(1, min(LANES, len(stream) // WINDOW), min(MOST_LANES, len(stream) // (WINDOW * LONG)))
    length = -(-len(stream) // lanes)
    cut = lambda x: np.resize(x, (lanes, length)).T
    symbols, before, fresh = cut(stream), cut(source), cut(first)
    p = {k: v.copy() for k, v in p.items()}
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    state, n = np.zeros((lanes, STATE), np.float32), 0
    for t in range(0, length, WINDOW):
        goal, given = symbols[t:t + WINDOW], before[t:t + WINDOW]
        g, state = gradients(p, goal, given, fresh[t:t + WINDOW], state, shape)
        n += 1
        shrink = np.float32(1 / max(1.0, math.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))))
        step, even = np.float32(rate / (1 - 0.9 ** n)), np.float32(1 / (1 - 0.99 ** n))
        seen = np.zeros(len(sizes), bool)
        seen[of[goal]] = True
        words = np.flatnonzero(seen[of])
        touched = {"embed": np.unique(given), "ww": words, "bw": words}
        for k, v in g.items():
            at = touched.get(k, slice(None))
            v, m, q = v[at] * shrink, mean[k][at], square[k][at]
            m += np.float32(0.1) * (v - m)
            v *= v
            v -= q
            q += np.float32(0.01) * v
            mean[k][at], square[k][at] = m, q
            q = np.sqrt(q * even)
            q += np.float32(1e-6)
            p[k][at] -= step * m / q
    return p


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    names = sorted(like)
    cuts = np.cumsum([like[k].size for k in names])[:-1]
    return {k: v.reshape(like[k].shape) for k, v in zip(names, np.split(flat, cuts))}


def text_scores(p: dict, texts: list[np.ndarray], shape: tuple | None = None) -> np.ndarray:
    """The log10 probability of each text's symbols.  All texts advance in step, longest first."""
    head = len(p["embed"]) - 2
    shape = shape or layout(head)
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    flat = np.concatenate([texts[i] for i in order])
    begin = np.cumsum(lengths) - lengths
    inputs = (p["embed"] @ p["wx"] + p["b"]).astype(np.float32)
    out = np.zeros(len(texts))
    state = np.zeros((len(texts), STATE), np.float32)
    before = np.full(len(texts), head + 1)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def settle() -> None:
        states, symbols = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        lane = np.concatenate([np.arange(len(h[1])) for h in held])
        out[:] += np.bincount(lane, log_probabilities(p, states, symbols, shape), len(out))

    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    for t, n in enumerate(active.tolist()):
        state = _cell(inputs[before[:n]], state[:n], p["wh"])[0]
        before = flat[begin[:n] + t]
        held.append((state, before))
        size += n
        if size > BLOCK_STATES:
            settle()
            held, size = [], 0
    if held:
        settle()
    result = np.empty(len(texts))
    result[order] = out / np.log(10)
    return result


# -- on tables -----------------------------------------------------------------------------

def trained(symbols: DataFrame, p: dict, rate: float, shape: tuple | None = None) -> tuple[dict, int]:
    """The parameters after a round over all ``symbols`` (one array for each text), and its tokens.

    Each task passes over all its texts; the average of the tasks' parameters, weighted by
    tokens, is taken in Spark as a tree of at most TREE sets at a node, so that the driver
    gets one set and no task many, whatever the number of tasks.
    """
    shape = shape or layout(len(p["embed"]) - 2)
    shipped = symbols.sparkSession.sparkContext.broadcast((p, shape))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (q, classes), held, size, n = shipped.value, [], 0, 0
        for batch in batches:
            column = batch.column(0)
            values, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
            ends = ends - ends[0]
            for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                held.append(values[begin:end])
                size += end - begin
                if size >= HELD_TOKENS:
                    q, held, size, n = train(q, held, rate, classes), [], 0, n + size
        if held:
            q, n = train(q, held, rate, classes), n + size
        if n:
            flat = _flat(q)
            parts = [flat[i:i + PART].tobytes() for i in range(0, len(flat), PART)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()),
                                              pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["part", "task", "n", "p"])
        release()

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        rows, total = rows.sort_values("task"), int(rows.n.sum())
        out = sum(n / total * np.frombuffer(x, np.float32).astype(np.float64) for n, x in zip(rows.n, rows.p))
        return pd.DataFrame({"part": [rows.part.iat[0]], "task": [rows.task.iat[0] // TREE], "n": [total], "p": [out.astype(np.float32).tobytes()]})

    kind, sets = "part int, task int, n long, p binary", symbols.rdd.getNumPartitions()
    parts = symbols.mapInArrow(shard, kind)
    while sets > 1:
        parts = parts.groupBy("part", F.floor(F.col("task") / TREE)).applyInPandas(average, kind)
        sets = -(-sets // TREE)
    # One set of parameters, in parts.
    parts = sorted(parts.collect())
    if not parts:
        return p, 0
    return _shaped(np.frombuffer(b"".join(bytes(r["p"]) for r in parts), np.float32), p), parts[0]["n"]


def fit(docs: DataFrame, train_rows: Column, text_col: str = "text") -> dict:
    """Counts of all training texts, and the network trained on all of them in every round."""
    rows = docs.where(train_rows)
    vocabulary = materialise(word_counts(rows.select(text_col)), "words")
    n, kinds = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = min(kinds, max(HEAD, vocabulary.where(F.col("c") >= math.sqrt(n) / RARITY).count()))
    top = vocabulary.orderBy(F.col("c").desc(), "word").limit(max(FREQUENT, head)).toArrow()
    words, counts = top.column("word").to_pylist(), top.column("c").to_numpy()
    model = {"N": n, "V": kinds, "vocabulary": vocabulary, "words": words, "counts": counts, "head": head}
    known = docs.sparkSession.sparkContext.broadcast({w: i + 1 for i, w in enumerate(words[:head])})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = known.value.get
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                texts = [np.fromiter(map(at, w, repeat(0)), np.int32, len(w)) for w in (tokens_of(t.as_py()) for t in batch.column(0).slice(begin, 1000))]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.list_(pa.int32()))], ["symbols"])
        release()

    symbols = materialise(rows.select(text_col).mapInArrow(encode, "symbols array<int>"), "symbols")
    shape = layout(head, np.append((n or 0) - counts[:head].sum(), counts[:head]))
    p, rate, seen = start_parameters(head, shape), RATE, []
    for _ in range(ROUNDS):
        p, tokens = trained(symbols, p, rate, shape)
        seen.append(tokens)
        rate /= 2
    return model | {"parameters": p, "shape": shape, "trained": seen}


NAMES = ["row", "doc_id", "held_out", "n_tokens", "n_known", "n_outside", "logs", "logs_outside", "network", "word", "n"]


def _table(columns: list, id_type: pa.DataType) -> pa.RecordBatch:
    types = [pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], NAMES)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, held_out): n_tokens, n_known,
    train_tokens, base_score (smoothed unigrams) and score (the network), in log10.

    Null and empty texts are the end alone; repeated rows stay.  The log counts of the most
    frequent words are added up on the way, those of all others by a join, so that every
    count is exact and no word of the join is in a large share of the rows.
    """
    head, mass = model["head"], model["N"] + model["V"] + 1
    outside = mass - int(model["counts"][:head].sum()) - head
    # Parameters put in for another head have the classes that start_parameters gives them.
    shape = model["shape"] if len(model["shape"][0]) == head + 1 else layout(head)
    shipped = docs.sparkSession.sparkContext.broadcast((model["parameters"], shape, model["words"], np.log10(model["counts"] + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, shape, words, logs = shipped.value
        known, none = {w: i for i, w in enumerate(words)}, len(words)
        logs = np.append(logs, 0.0)
        facts: list[tuple] = []
        symbols: list[np.ndarray] = []
        size, id_type = 0, pa.int64()

        def scored() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*facts)]
            return _table([*columns, text_scores(p, symbols, shape), [None] * len(facts), [None] * len(facts)], id_type)

        def apart(rows: list, rare: list, times: list) -> pa.RecordBatch:
            return _table([rows, *[[None] * len(rows)] * 8, rare, times], id_type)

        for batch in batches:
            id_type = batch.column(1).type
            rows, rare, times = [], [], []
            for row, doc, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                tokens = tokens_of(text.as_py())
                at = np.fromiter(map(known.get, tokens, repeat(none)), np.int32, len(tokens))
                symbol = np.where(at < head, at + 1, 0)
                missing = int((at == none).sum())
                if missing:
                    others = Counter([w for w in tokens if w not in known])
                    rows.extend([row] * len(others))
                    rare.extend(others)
                    times.extend(others.values())
                facts.append((row, doc, held, len(tokens), len(tokens) - missing, int((symbol == 0).sum()),
                              float(logs[at].sum()), float(logs[at[symbol == 0]].sum())))
                symbols.append(symbol)
                size += len(tokens)
                if len(rows) > 50_000:
                    yield apart(rows, rare, times)
                    rows, rare, times = [], [], []
                if size > BLOCK_TOKENS:
                    yield scored()
                    facts, symbols, size = [], [], 0
            if rows:
                yield apart(rows, rare, times)
        if facts:
            yield scored()
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, n_outside long, logs double, logs_outside double, "
             "network double, word binary, n long"), "tokens")
    rare = (both.where("word is not null").select("row", "word", "n").join(model["vocabulary"], "word", "left")
            .groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
                                F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_logs")))
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return both.where("word is null").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model["N"]).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * float(np.log10(mass))).alias("base_score"),
        (F.col("network") + F.col("logs_outside") + rare_logs - F.col("n_outside") * float(np.log10(outside))).alias("score"))


def language_model(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Score every document; rows whose crc32(id) mod ``folds`` is ``held`` are not learnt from."""
    out = id_crc("doc_id") % folds == held
    return score(docs.select("doc_id", "text", out.alias("held_out")), fit(docs.select("doc_id", "text"), ~out))

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import ODD, documents, prose
from pyspark.sql import functions as F
from rollbook.llm import recurrent_lm as m


def small(head=40, seed=1):
    rng = np.random.default_rng(seed)
    return {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float64) for k, v in m.start_parameters(head).items()}


def test_all_symbols_together_have_probability_one():
    p, shape = small(), m.layout(40)
    state = np.random.default_rng(0).normal(size=(1, m.STATE))
    logs = m.log_probabilities(p, np.repeat(state, 41, 0), np.arange(41), shape)
    assert np.exp(logs).sum() == pytest.approx(1)


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(np, "float32", np.float64)
    p, shape = small(), m.layout(40)
    rng = np.random.default_rng(3)
    symbols, before = rng.integers(0, 41, (5, 3)), rng.integers(0, 42, (5, 3))
    fresh, state = rng.random((5, 3)) < 0.3, rng.normal(size=(3, m.STATE))

    def loss(q):
        h, total = state, 0.0
        inputs = q["embed"][before] @ q["wx"] + q["b"]
        for t in range(5):
            h = m._cell(inputs[t], np.where(fresh[t][:, None], 0.0, h), q["wh"])[0]
            total -= m.log_probabilities(q, h, symbols[t], shape).sum()
        return total / 15

    g, _ = m.gradients(p, symbols, before, fresh, state, shape)
    for name, value in p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += 1e-5
            up = loss(q)
            q[name][at] -= 2e-5
            assert g[name][at] == pytest.approx((up - loss(q)) / 2e-5, abs=1e-6), name


def test_windows_and_lanes_do_not_change_a_score(monkeypatch):
    p = {k: v.astype(np.float32) for k, v in small().items()}
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 41, n) for n in (1, 300, 7, 7, 1, 90)]
    want = []
    for t in texts:  # one text, one step at a time
        h, before, total = np.zeros((1, m.STATE), np.float32), 41, 0.0
        for s in t.tolist():
            h = m._cell((p["embed"][[before]] @ p["wx"] + p["b"]), h, p["wh"])[0]
            total += m.log_probabilities(p, h, np.array([s]), m.layout(40))[0]
            before = s
        want.append(total / math.log(10))
    assert m.text_scores(p, texts) == pytest.approx(want, rel=1e-4)
    monkeypatch.setattr(m, "BLOCK_STATES", 10)
    assert m.text_scores(p, texts) == pytest.approx(want, rel=1e-4)


def test_training_learns_what_follows_what():
    stream = [np.array([1, 2, 3, 4] * 40) for _ in range(40)]
    p = m.start_parameters(40)
    before = m.text_scores(p, stream[:1])[0]
    for _ in range(3):
        p = m.train(p, stream, m.RATE)
    assert m.text_scores(p, stream[:1])[0] > before / 2
    assert m.train(p, [], m.RATE) is p


def corpus():
    rng = random.Random(7)
    many = [f"t{i}" for i in range(500)]
    rows = [(100 + i, "Start " + prose(rng, rng.randint(0, 80), many[: 20 + i]) + f" only{i} only{i}") for i in range(150)]
    return rows + ODD + [(100, "a repeated ID")]


@pytest.mark.parametrize("frequent", [200_000, 30])
def test_counts_and_base_scores_are_exact(spark, monkeypatch, frequent):
    monkeypatch.setattr(m, "FREQUENT", frequent)
    monkeypatch.setattr(m, "ROUNDS", 1)
    rows = corpus()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    tokens = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens) if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i is None, i or 0, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6))
                  for (i, _), ws in zip(rows, tokens))
    got = m.language_model(documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_where_the_counts_are_joined_does_not_matter(spark, monkeypatch):
    docs = documents(spark, corpus())
    monkeypatch.setattr(m, "ROUNDS", 1)
    monkeypatch.setattr(m, "HEAD", 20)
    scores = []
    for frequent in (200_000, 30):
        monkeypatch.setattr(m, "FREQUENT", frequent)
        scores.append(sorted((r.n_tokens, r.base_score, r.score) for r in m.language_model(docs).collect()))
    assert np.allclose(np.array(scores[0]), np.array(scores[1]))


def test_probabilities_of_all_next_words_sum_to_one(spark):
    """Head, other known words and one unknown word share out the probability of a first word."""
    docs = documents(spark, [(i, "a a a b b c") for i in range(30)]).withColumn("held_out", F.lit(False))
    model = m.fit(docs.select("doc_id", "text"), F.lit(True)) | {"head": 2}
    model["parameters"] = m.start_parameters(2)
    one = documents(spark, [(i, w) for i, w in enumerate(["a", "b", "c", "unseen", ""])]).withColumn("held_out", F.lit(False))
    p, first = model["parameters"], []
    got = {r.doc_id: r.score for r in m.score(one.select("doc_id", "text", "held_out"), model).collect()}
    order = {w: i + 1 for i, w in enumerate(model["words"][:2])}
    for i, w in enumerate([b"a", b"b", b"c", b"unseen"]):
        symbols = np.array([order.get(w, 0), order.get(b"", 0)])
        end = m.text_scores(p, [symbols])[0] - m.text_scores(p, [symbols[:1]])[0]
        outside = model["N"] + model["V"] + 1 - int(model["counts"][:2].sum()) - 2
        end += 0 if order.get(b"") else math.log10((dict(zip(model["words"], model["counts"]))[b""] + 1) / outside)
        first.append(10 ** (got[i] - end))
    first.append(10 ** got[4])
    assert sum(first) == pytest.approx(1, rel=1e-3)


def test_empty_table_and_nothing_to_learn_from(spark):
    assert m.language_model(documents(spark, [])).count() == 0
    docs = documents(spark, ODD)
    got = m.score(docs.select("doc_id", "text", F.lit(True).alias("held_out")), m.fit(docs.select("doc_id", "text"), F.lit(False))).collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in got} == {(0, 0, 0.0)} and all(math.isfinite(r.score) for r in got)


def test_every_round_learns_from_every_training_text_and_the_head_grows(spark):
    """More texts than any fixed sample, in several tasks; more common words than the least head."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % 1500}" for j in range(20))) for i in range(3500)]
    rows += [(i, "again x") for i in range(50)] + [(None, "no id"), (None, None)]
    model = m.fit(documents(spark, rows).repartition(3), F.col("doc_id").isNull() | (F.col("doc_id") >= 0))
    assert model["N"] == sum(len((t or "").split()) + 1 for _, t in rows)
    assert model["trained"] == [model["N"]] * m.ROUNDS
    assert model["head"] == 1500 + 3 and len(m.layout(model["head"])[2]) - 1 <= 41


def test_no_token_is_cut_off_between_lanes(monkeypatch):
    seen = []
    monkeypatch.setattr(m, "gradients", lambda p, symbols, *_: (seen.append(symbols.ravel()), ({}, np.zeros(1)))[1])
    m.train(m.start_parameters(3000), [np.arange(1, 2500), np.arange(2500, 3001)], m.RATE)
    assert set(np.concatenate(seen).tolist()) == set(range(1, 3001))


@pytest.mark.parametrize("counts", [None, [500, 900, 300, 200, 100, 50] + [3] * 35, [0] + [1] * 40, [7] + [0] * 40])
def test_classes_are_cut_by_root_frequency_and_hold_every_word_once(counts):
    of, place, sizes = m.layout(40, None if counts is None else np.array(counts))
    assert of[0] == 0 and sizes[0] == 1 and sizes.sum() == 41 and (sizes > 0).all()
    assert (np.diff(of) >= 0).all() and sorted(zip(of.tolist(), place.tolist())) == [(k, i) for k, n in enumerate(sizes.tolist()) for i in range(n)]
    if counts and len(set(counts)) > 3:
        assert sizes[1] < sizes[-1] and sizes[-1] > 3
    p = m.start_parameters(40, (of, place, sizes))
    logs = m.log_probabilities(p, np.ones((41, m.STATE), np.float32), np.arange(41), (of, place, sizes))
    assert np.exp(logs).sum() == pytest.approx(1, rel=1e-5)
    assert all(len(x) == 1 for x in m.layout(0))


def test_rows_far_apart_keep_their_softmax():
    x = np.array([[0.0, 1.0], [500.0, 499.0], [-700.0, -701.0]])
    want = [x[i, c] - np.logaddexp(*x[i]) for i, c in enumerate((0, 1, 1))]
    assert m._log_chosen(x.copy(), np.array([0, 1, 1])) == pytest.approx(want)
    assert m._softmax_less(x.copy(), np.array([0, 1, 1]), 1.0)[2] == pytest.approx([1 / (1 + np.exp(-1)), np.exp(-1) / (1 + np.exp(-1)) - 1])


def test_the_average_of_many_tasks_is_a_tree_over_all_of_them(spark, monkeypatch):
    monkeypatch.setattr(m, "TREE", 2)
    rows = [([1, 2, 3] * (i % 4 + 1),) for i in range(40)]
    symbols = spark.createDataFrame(rows, "symbols array<int>").repartition(7)
    p, n = m.trained(symbols, m.start_parameters(5), 0.0)
    assert n == sum(len(r[0]) for r in rows)
    assert all(np.allclose(p[k], v, atol=1e-6) for k, v in m.start_parameters(5).items())

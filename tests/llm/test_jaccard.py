import random
import tracemalloc

import numpy as np
import pytest
from odd import ODD, documents, prose
from rollbook.llm import components as c
from rollbook.llm import jaccard_join as j


def sets(rows, words):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        out.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set())
    return out


def brute(rows, words, percent):
    """(doc_id, set size, least id in reach) by comparing all pairs."""
    found = sets(rows, words)
    home = list(range(len(rows)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if found[a] and found[b] and 100 * len(found[a] & found[b]) >= percent * len(found[a] | found[b]):
                home[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in (doc, least.get(root(i))) if x is not None]
        least[root(i)] = min(ids) if ids else None
    return sorted(((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, found))), key=str)


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(w))
            w[at:at + rng.choice([0, 1, 1])] = [f"new{rng.randrange(10**6)}"]
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    many = [f"w{i}" for i in range(3000)]
    texts = [prose(rng, rng.randint(1, 60), many) for _ in range(60)]
    passage = prose(rng, 30, many)
    texts += [prose(rng, rng.randint(0, 40), many) + " " + passage + " " + prose(rng, 20, many) for _ in range(40)]
    for size, edits in ((40, 2), (30, 6), (5, 1), (25, 12)):
        texts += family(rng, prose(rng, rng.randint(60, 150), many), size, edits)
    chain = prose(rng, 100, many).split()
    for i in range(25):  # neighbours are similar, the ends are not
        chain[4 * i] = f"chain{i}"
        texts.append(" ".join(chain))
    texts += [texts[3]] * 30 + ["Same THING here", "same thing here", "a b", "a  B", "a"]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(1000 + (i or 0), t) for i, t in ODD] + [(None, "x"), (None, None)]


@pytest.mark.parametrize("seed, words, percent", [(1, 3, 90), (2, 5, 80), (3, 1, 50)])
def test_matches_all_pairs(spark, monkeypatch, seed, words, percent):
    if seed == 3:
        monkeypatch.setattr(j, "FREQUENT", 3)
    rows = corpus(seed)
    got = j.ngram_jaccard(documents(spark, rows), words, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, words, percent)


def test_one_of_each(spark):
    rows = corpus(4)
    docs = documents(spark, rows)
    got = j.one_of_each(docs, 5, 80)
    assert got.columns == docs.columns
    want = brute(rows, 5, 80)
    empty = sum(1 for _, n, _ in want if n == 0)
    with_words = {(c, ) for _, n, c in want if n}
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(kept))
    assert len([k for k in kept if (k[1] or "").split()]) == len(with_words) and empty >= len([k for k in kept if not (k[1] or "").split()]) > 0


def test_empty_table(spark):
    assert j.ngram_jaccard(documents(spark, [])).count() == 0 and j.one_of_each(documents(spark, [])).count() == 0
    assert [tuple(r) for r in j.ngram_jaccard(documents(spark, [(5, None)])).collect()] == [(5, 0, 5)]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)] + [(160, 159), (5, 5)]
    got = {r.node: r.root for r in c.components(spark.createDataFrame(chain + star + chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 161)}
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_write_no_round_when_all_are_stars(spark, monkeypatch):
    written, write = [], c.materialise
    monkeypatch.setattr(c, "materialise", lambda df, kind: written.append(kind) or write(df, kind))
    # The least node is the middle of each star; a repeated edge and a loop change nothing.
    star = spark.createDataFrame([(1, i) for i in range(2, 30)] + [(40, 31), (1, 2), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in c.components(star).collect()} == {i: 1 for i in range(1, 30)} | {31: 31, 40: 31}
    assert len(written) == 1
    for edges in ([(1, 2), (2, 3)], [(1, 3), (2, 3)], [(1, 4), (2, 4), (2, 3)]):
        assert {r.root for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()} == {1}


def test_with_least_keeps_every_row_of_hot_and_single_keys(spark):
    rows = [("hot", i % 700) for i in range(5, 3000)] + [(f"k{i}", i) for i in range(50)] + [("k7", 3), ("k7", 3), (None, 1)]
    got = sorted((r.a, r.b, r.m) for r in c.with_least(spark.createDataFrame(rows, "a string, b long"), ["a"], "b", "m").collect())
    least = {}
    for a, b in rows:
        least[a] = min(b, least.get(a, b))
    assert got == sorted((a, b, least[a]) for a, b in rows if a is not None)
    none = c.with_least(spark.createDataFrame([], "a string, b long"), ["a"], "b", "m")
    assert none.columns == ["a", "b", "m"] and none.count() == 0


def test_blocks_are_bounded_by_sets(spark):
    """Many short sets of one family, few shingles in all: 9,000 sets of 8."""
    members = spark.range(9000).selectExpr("cast(string(id) as binary) AS class_id", "'f' AS family", "8 AS size", "id AS home")
    blocks = [r["count"] for r in j.in_blocks(members, 80).groupBy("family", "band", "salt").count().collect()]
    assert sum(blocks) == 9000 and max(blocks) < 1.25 * j.BLOCK_SETS


def test_blocks_need_no_whole_matrices_of_numbers():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 8)) for _ in range(1500)]
    tracemalloc.start()
    got = j.links_of_blocks(sets, sets, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 1500 * 1500 * 2  # bytes of two int64 matrices
    for a in range(0, 1500, 97):
        want = [100 * len(np.intersect1d(sets[a], s)) >= 50 * len(np.union1d(sets[a], s)) for s in sets]
        assert got[a].tolist() == want


def test_small_blocks_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK_SETS", 3)
    monkeypatch.setattr(j, "FREQUENT", 3)
    monkeypatch.setattr(j, "STRIP", 2)
    rng = random.Random(9)
    rows = [(i, "one two " + " ".join(rng.choice("abcd") for _ in range(8))) for i in range(60)]
    got = j.ngram_jaccard(documents(spark, rows), 3, 60).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 3, 60)


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_filter_of_ids_misses_none(spark, monkeypatch, most):
    monkeypatch.setattr(j, "MAX_WORDS", most)
    rows = spark.createDataFrame([(None,), (-1,), *[(i * 7,) for i in range(300)], (0,)], "doc_id long")
    known = j.id_filter(rows)
    assert len(known) == min(most, 303 // 4 + 1)
    hashed = lambda df: j.id_hashes(df).toPandas()
    ids = hashed(rows)
    assert j.in_filter(known, ids.place.to_numpy(), ids.bits.to_numpy()).all()
    others = hashed(spark.range(10_000, 14_000).toDF("doc_id"))
    let_in = j.in_filter(known, others.place.to_numpy(), others.bits.to_numpy()).mean()
    assert most == 1 or let_in < 0.05
    none = j.id_filter(rows.limit(0))
    assert not j.in_filter(none, ids.place.to_numpy(), ids.bits.to_numpy()).any()


def test_whole_sets_do_not_shuffle_texts(spark, monkeypatch):
    rows = [(1, "a b c d"), (2, "e f g h"), (None, "i j k l"), (1, "other text of it"), (3, "")]
    docs = documents(spark, rows)
    marked = j.sketches(docs.select("doc_id", "text"), 3, 90, np.empty(0, np.int64)).where("size > 0")
    classes = spark.createDataFrame([(r.class_id, r.doc_id) for r in marked.collect() if r.doc_id != 2], "class_id binary, doc_id long")
    plans, write = {}, j.materialise
    monkeypatch.setattr(j, "materialise", lambda df, kind: plans.update({kind: df._jdf.queryExecution().executedPlan().toString()}) or write(df, kind))
    used = classes.where("doc_id is null or doc_id = 1").select("class_id")
    got = {bytes(r.class_id): sorted(r.tokens) for r in j.whole_sets(used, docs, classes, 3).collect()}
    assert "Exchange" not in plans["sets"]
    want = {bytes(r.class_id) for r in classes.collect()}
    assert want <= got.keys()
    hashes = j.WordHashes()
    sets_of = {j.fingerprint(s): s.tolist() for s in (j.shingles(t, 3, hashes) for _, t in rows) if len(s)}
    assert all(sets_of[k] == v for k, v in got.items())

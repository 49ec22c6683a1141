import math
import random
from collections import Counter

import numpy as np
import pytest
from odd import ODD, documents, prose
from rollbook.llm import importance as m


def labelled(spark, n=300):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(rng, rng.randint(20, 150))
        if not good:
            text = rng.choice([" ".join(w + "!!" for w in text.split()), " ".join(f"{w} {w} {w} {w}" for w in text.split())])
        rows.append((100 + i, text))
        marks.append((100 + i, int(good), "x"))
    labels = spark.createDataFrame(marks + [(None, 1, "x"), (1, None, "x"), (101, 1, "y")], "doc_id long, quality int, score string")
    return documents(spark, rows + ODD), labels, {a: b for a, b, _ in marks}


def test_ratios_match_counts_by_hand(spark):
    rows = [(1, "good text good text"), (2, "bad bad bad !!"), (3, None), (4, "Good Text")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0)], "doc_id long, quality int")
    got = m.fit(documents(spark, rows), labels)
    hashes = m.Hashes()
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(m.ngram_buckets(t, hashes).tolist())
        if i == 1:  # 4 is labelled both ways
            target.update(m.ngram_buckets(t, hashes).tolist())
    n, k = sum(raw.values()), sum(target.values())
    want = [math.log((target[b] + 1) / (k + m.BUCKETS)) - math.log((raw[b] + 1) / (n + m.BUCKETS)) for b in range(m.BUCKETS)]
    assert np.allclose(got, want)


def test_repeated_tokens_share_a_marker():
    a, b = (m.ngram_buckets(t, m.Hashes()) for t in ("one one", "two two"))
    assert len(a) == 3 and a[1] == b[1] and a[0] != b[0]


def test_good_documents_are_kept(spark):
    docs, labels, truth = labelled(spark)
    got = m.resample(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id in truth:
            assert r.selected == bool(truth[r.doc_id])
    assert len({(r.log_weight, r.key) for r in got if r.doc_id == 8}) == 1
    assert all(r.log_weight == 0 for r in got if r.doc_id in (1, 2, 3))


def test_gumbel_top_k_is_exact_and_in_proportion(spark):
    docs = documents(spark, [(i, "a" if i % 2 else "b") for i in range(4000)])
    ratios = np.zeros(m.BUCKETS)
    ratios[m.ngram_buckets("a", m.Hashes())] = math.log(3)
    weighed = m.weighed_table(docs, ratios)
    keys = sorted((r.key for r in weighed.collect()), reverse=True)
    for k in (0, 1, 7, 2000, 3999, 4000, 9000):
        got = m.sample(weighed, k).where("selected").collect()
        assert sorted((r.key for r in got), reverse=True) == keys[:k]
    odd = sum(r.doc_id % 2 for r in m.sample(weighed, 400).where("selected").collect())
    assert 0.68 < odd / 400 < 0.82  # three in four


def test_kth_largest_with_ties(spark):
    values = [1.0, 5.0, 5.0, 5.0, 2.0, -3.0, 1e300, 1e-300, 5.0]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in range(1, len(values)):
        assert m.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert m.kth_largest(df, len(values)) is None and m.kth_largest(df, 0) == math.inf


@pytest.mark.parametrize("y", [[], [1, 1], [0, 0]])
def test_one_kind_of_label_or_none(spark, y):
    labels = spark.createDataFrame([(4 + i, v) for i, v in enumerate(y)], "doc_id long, quality int")
    assert all(r.selected for r in m.resample(documents(spark, ODD), labels).collect())


def test_empty_table(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert m.resample(documents(spark, []), labels).count() == 0

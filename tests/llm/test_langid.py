import random
import zlib

import numpy as np
import pytest
from odd import ODD, documents, prose
from pyspark.sql import functions as F
from rollbook.llm import langid as m

SETS = {"aa": "the and of that with from this for".split(), "bb": "der die und das nicht ein ist mit".split(), "cc": "que los una por con del las para".split()}


def table(spark, n=240):
    rng = random.Random(5)
    lang = lambda i: sorted(SETS)[i % 3]
    rows = [(100 + i, prose(rng, rng.randint(3, 60), SETS[lang(i)])) for i in range(n)]
    df = documents(spark, rows + ODD)
    names = F.create_map(*[F.lit(x) for i in range(n) for x in (100 + i, lang(i))])
    return df.withColumn("lang", F.when(F.col("doc_id") >= 100, F.element_at(names, F.col("doc_id").cast("int")))), {100 + i: lang(i) for i in range(n)}


def test_held_out_accuracy_and_odd_rows(spark):
    docs, truth = table(spark)
    got = m.language_id(docs).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1)
        if r.doc_id in (1, 2, 3, 6):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 8}) == 1


def test_matches_naive_bayes_by_hand(spark):
    rows = [("ab ab", "x"), ("ba", "y"), ("abc", "x"), (None, "x"), ("no label", None), ("123", "y")]
    model = m.fit(spark.createDataFrame(rows, "text string, lang string"))

    def buckets(text):
        return [int(b) for found, a, z in m.ngram_buckets([text]) for b in found[a[0]:z[0]]]

    counts = {"x": buckets("ab ab") + buckets("abc"), "y": buckets("ba")}
    assert len(buckets("abc")) == 3 + 2 + 1 and len(buckets("a")) == 1
    text = "abca"
    logs = []
    for lang, docs in (("x", 2), ("y", 1)):
        have = np.bincount(counts[lang], minlength=m.BUCKETS)
        logs.append(np.log((docs + 1) / (3 + 2)) + sum(np.log((have[b] + 1) / (len(counts[lang]) + m.BUCKETS)) for b in buckets(text)))
    (r,) = m.predict(spark.createDataFrame([(text,)], "text string"), model).collect()
    want = np.exp(logs - np.max(logs))
    assert r.lang_pred == "xy"[int(np.argmax(logs))] and r.score == pytest.approx(want.max() / want.sum(), rel=1e-4)


def test_grams_do_not_cross_texts():
    together = [f[0][f[1][1]:f[2][1]].tolist() for f in m.ngram_buckets(["abc", "de", "", "f"])]
    alone = [f[0][f[1][0]:f[2][0]].tolist() for f in m.ngram_buckets(["de"])]
    assert together == alone


def test_nothing_to_learn_from(spark):
    got = m.language_id(documents(spark, ODD).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert m.language_id(documents(spark, [])).count() == 0


def test_held_out_rows_are_not_learnt_from(spark):
    docs, _ = table(spark, 90)
    turned = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted((r.doc_id or -1, r.lang_pred, r.score) for r in m.language_id(d).collect()) for d in (docs, turned))
    assert a == b

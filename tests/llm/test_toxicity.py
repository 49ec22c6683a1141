import random
import zlib

import numpy as np
import pytest
from odd import ODD, documents, prose
from rollbook.llm import toxicity as x


def test_grams_of_a_word():
    keys, owner = x.grams(["ab", "c"])
    a, b, c = (2 + ord(ch) % (x.MASK - 1) for ch in "abc")
    pack = lambda *codes: sum(v << (x.BITS * i) for i, v in enumerate(reversed(codes)))
    assert keys.tolist() == [pack(a), pack(a, b), pack(a, b, x.END), pack(c), pack(c, x.END)] and owner.tolist() == [0, 0, 0, 1, 1]


def brute(counts: dict, order: int):
    """Kneser-Ney as written down: dictionaries and recursion."""
    types = {g for y in (0, 1) for g in counts[y]}
    lower = []
    for n in range(order - 1, 0, -1):
        found: dict = {}
        for g in types:
            found.setdefault(g[1:], set()).add(g[0])
        lower.append({g: len(s) for g, s in found.items()})
        types = set(found)
    lower = {n: t for n, t in zip(range(order - 1, 0, -1), lower)}

    def shared(g):
        n = len(g)
        if n == 0:
            return 1.0 / x.MASK
        table = lower[n]
        total = sum(c for h, c in table.items() if h[:-1] == g[:-1])
        kinds = sum(1 for h in table if h[:-1] == g[:-1])
        return (max(table.get(g, 0) - x.DISCOUNT, 0) + x.DISCOUNT * kinds * shared(g[1:])) / total if total else shared(g[1:])

    def prob(y, g):
        total = sum(c for h, c in counts[y].items() if h[:-1] == g[:-1])
        kinds = sum(1 for h in counts[y] if h[:-1] == g[:-1])
        if not total:
            return shared(g[1:])
        return max(counts[y].get(g, 0) - x.DISCOUNT, 0) / total + x.DISCOUNT * kinds / total * shared(g[1:])

    return prob


def test_ratios_match_kneser_ney_by_hand():
    texts = {1: "bad bads badly", 0: "ball bald bell badly"}
    counts = {y: {} for y in (0, 1)}
    unpack = lambda k: tuple((k >> (x.BITS * i)) & x.MASK for i in range(x.ORDER - 1, -1, -1))
    packed = {}
    for y, text in texts.items():
        for k in x.grams(text.split())[0].tolist():
            packed[unpack(k)] = k
            counts[y][unpack(k)] = counts[y].get(unpack(k), 0) + 1
    prob = brute(counts, x.ORDER)
    grams = sorted(packed)
    keys = np.array([packed[g] for g in grams])
    tables = x.ratio_tables(keys, *(np.array([counts[y].get(g, 0) for g in grams]) for y in (1, 0)))
    want = {packed[g]: np.log(prob(1, g)) - np.log(prob(0, g)) for g in grams}
    assert tables[1] == pytest.approx([want[k] for k in tables[0].tolist()], rel=1e-4, abs=1e-5)


def labelled(spark, n=400):
    rng = random.Random(1)
    bad = ["grubeful", "grubish", "snarkle", "snarkles"]
    rows, marks = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(rng, rng.randint(20, 200)).split()
        for _ in range(max(2, len(words) // 25) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((100 + i, " ".join(words)))
        marks.append((100 + i, 1, int(toxic), "x"))
    return documents(spark, rows + ODD), spark.createDataFrame(marks + [(1, 1, 1, "x"), (None, 1, 1, "x"), (101, 1, None, "x"), (7777, 1, 1, "x")],
                                                        "doc_id long, quality int, toxic int, text string"), {m[0]: m[2] for m in marks}


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels, truth = labelled(spark)
    got = x.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    same = [r.score for r in got if r.doc_id == 8]
    assert len(same) == 2 and same[0] == same[1]
    # An unseen form of a known stem is judged by the stem.
    model = x.fit(docs, labels)
    unseen = x.score(documents(spark, [(1, "alpha beta grubest gamma snarkled delta"), (2, "alpha beta gamma delta")]), model).collect()
    assert unseen[0].score > unseen[1].score


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in x.toxicity(documents(spark, ODD), none).collect()} == {0.0}
    one = spark.createDataFrame([(4, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in x.toxicity(documents(spark, ODD), one).collect()} == {0}
    assert x.toxicity(documents(spark, []), none).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels, _ = labelled(spark, 120)
    from pyspark.sql import functions as F
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id or -1, r.score) for r in x.toxicity(docs, t).collect()) for t in (labels, turned))
    assert a == b


def test_sample_is_bounded_by_rows_and_characters(spark):
    rows = [(i, "grub " * (1 + i % 7)) for i in range(200)] + [(5, "x"), (300, "y" * 900), (301, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(302)], "doc_id long, toxic int")
    got = x.sample(documents(spark, rows), labels, per_class=60, chars=700, longest=800).collect()
    texts = dict(rows) | {5: "x"}
    for y in (0, 1):
        mine = sorted((r for r in got if r.y == y), key=lambda r: (r.h, r.id))
        assert 0 < sum(len(r.text) for r in mine) <= 700 and len(mine) <= 60
    assert all(r.text == texts[r.id] and r.y == r.id % 2 and len(r.text) <= 800 for r in got)
    every = x.sample(documents(spark, rows), labels).collect()
    assert sorted(r.id for r in every) == [*range(200), 300]

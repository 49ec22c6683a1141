"""Merkle manifests against trees built in plain Python, and proofs of changed rows."""

import random
import zlib
from hashlib import sha256

import pytest
from odd import ODD, documents
from pyspark.sql import functions as F

from rollbook.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return sha256("".join(parts).encode("utf-8")).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    """(root, the siblings and sides of each leaf) by rounds over a list."""
    steps, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, a in enumerate(at):
            b = a ^ 1
            steps[i].append((level[b], b < a) if b < len(level) else (None, False))
        level, at = [h(*level[i:i + 2]) for i in range(0, len(level), 2)], [a // 2 for a in at]
    return level[0], steps


def expected(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    order = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for i, t, lang, source, n in rows:
        claimed = n + 1 if n is not None and zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 0 else n
        groups.setdefault(lang, []).append((order(i), leaf_of(i, source, lang, n, t), i, leaf_of(i, source, lang, claimed, t)))
    langs = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = {g: (sorted(groups[g], key=lambda x: x[:2]), *tree([x[1] for x in sorted(groups[g], key=lambda x: x[:2])])) for g in langs}
    root, upper = tree([built[g][1] for g in langs]) if langs else (None, [])
    out = []
    for g, up in zip(langs, upper):
        leaves, subroot, steps = built[g]
        for (_, leaf, i, claimed), way in zip(leaves, steps):
            now = claimed
            for other, left in way + up:
                now = h(now) if other is None else h(other, now) if left else h(now, other)
            out.append((i, leaf, subroot, root, h(*(o for o, _ in way + up if o)), now, now == root))
    return out


def table(spark, rows):
    clash = ["grp", "row", "leaf", "idx", "level", "path", "size", "digest"]
    return spark.createDataFrame([(*r, *["x"] * len(clash)) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))


@pytest.mark.parametrize("n,levels", [(1, 10), (2, 10), (5, 1), (70, 2), (300, 3), (300, 10)])
def test_trees_and_proofs_by_hand(spark, n, levels):
    rng = random.Random(n)
    rows = [(i * 3 + 1, f"text {rng.random()}", rng.choice(["en", "fr", "é", "z", None, ""]) if i else "one", f"src{i % 3}", rng.choice([None, i])) for i in range(n)]
    rng.shuffle(rows)
    found = merkle.manifest(table(spark, rows).repartition(7), merkle.tampered_n_chars(), levels).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == sorted(expected(rows))


def test_odd_rows_ties_and_clashing_names(spark):
    rows = [(i, t, lang, "s" if i else None, n) for k, (i, t) in enumerate(ODD * 2) for lang, n in [((None, "en", "de")[k % 3], None if k % 4 else k)]]
    found = merkle.manifest(table(spark, rows), merkle.tampered_n_chars(), 2).select(*COLUMNS).collect()
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted(expected(rows), key=key)
    assert any(not r["verified"] for r in found) and any(r["verified"] for r in found)


def test_empty_table_and_untouched_rows(spark):
    assert merkle.manifest(documents(spark, [])).collect() == []
    rows = [(i, f"t{i}", "en", "s", i) for i in range(40)]
    assert all(r["verified"] for r in merkle.manifest(table(spark, rows)).collect())
    # A proof's row changed in any hashed column no longer leads to the root.
    one = merkle.manifest(table(spark, rows)).where("doc_id = 17").first()
    assert merkle.folded(bytes.fromhex(leaf_of(17, "s", "en", 17, "t17")), one["sides"], bytes(one["path"])).hex() == one["root"]
    for changed in ((18, "s", "en", 17, "t17"), (17, None, "en", 17, "t17"), (17, "s", None, 17, "t17"), (17, "s", "en", 1, "t17"), (17, "s", "en", 17, "")):
        assert merkle.folded(bytes.fromhex(leaf_of(*changed)), one["sides"], bytes(one["path"])).hex() != one["root"]


def test_distance_doubles(spark):
    rows = spark.range(1000).select(F.lit("g").alias("grp"), "id", F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest")).select(
        "grp", "digest", F.struct("id").alias("row"))
    nodes, roots, highest = merkle.trees(merkle.numbered(rows, ["row.id"]), 4)
    assert highest == 10 and roots.count() == 1
    assert nodes.groupBy("level").count().orderBy("level").collect() == [(k, -(-1000 // 2 ** k)) for k in range(10)]
    assert {len(r["sides"]) for r in merkle.jumped(nodes, highest).collect()} == {10}

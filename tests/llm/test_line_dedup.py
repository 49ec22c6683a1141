"""Line dedup against a brute-force version, at filters of every size."""

import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from odd import ODD, documents, prose

from rollbook.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least=20, copies=3):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(line) for line in (t or "").split("\n")}:
            if len(k) >= least:
                holders[k].append(i)
    out = []
    for i, t in rows:
        lines, kept = (t or "").split("\n"), []
        for line in lines:
            held = holders.get(key(line), [])
            known = [x for x in held if x is not None]
            if len(held) < copies or i == (max(known) if known else None):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def found(spark, rows, **how):
    df = line_dedup.dedup(documents(spark, rows).repartition(5), **how)
    return ordered(tuple(r) for r in df.select("row.doc_id", "n_lines", "n_dropped", "kept").collect())


LINES = ["The same line of twenty", "  tHE SAME line OF TWENTY\t", "ünïcödé líné öf twënty çhars", "short", "", "exactly twenty chars", "just nineteen chars", "\x0b\x1c odd line ends here \x1c\r", "東京は日本の首都であり大きな都市である。"]


@pytest.mark.parametrize("most_bits", [line_dedup.SEGMENT, line_dedup.MOST_BITS])
def test_like_brute_force(spark, most_bits):
    rng = random.Random(5)
    rows = [(i * 7 % 501, "\n".join(rng.choice(LINES) if rng.random() < 0.4 else prose(rng, 6) for _ in range(rng.randrange(1, 9)))) for i in range(300)]
    rows += [(1000 + i, "A license line that a third of all rows hold.\n" + prose(rng, 8)) for i in range(150)]
    assert found(spark, rows, most_bits=most_bits) == ordered(expected(rows))


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "\n".join([prose(rng, 7), rng.choice(LINES)])) for i in range(200)]
    # Every line is suspected.
    monkeypatch.setattr(line_dedup, "twice_seen", lambda docs, text, least, bits: np.full(bits // 8, 255, np.uint8))
    assert found(spark, rows) == ordered(expected(rows))


def test_hot_lines_by_broadcast_and_others_by_join(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice([f"line number {k} of a few more" for k in range(30)] + ["the one line that is everywhere"] * 60) for _ in range(4))) for i in range(200)]
    for share in (0.0, 0.05, 1.0):
        monkeypatch.setattr(line_dedup, "HOT", share)
        assert found(spark, rows) == ordered(expected(rows))


def test_odd_rows_null_ids_and_ties(spark):
    line = "a line that is long enough to count"
    rows = [*ODD, (None, line), (None, line + "\n" + line), (20, line), (20, line), (19, "x\n" + line + "\n" + line), (18, None), (17, "\n\n"),
            *[(None, "only null ids hold this line here")] * 4, (21, "   \n" + "y" * 30 + "\n" + line.upper())]
    assert found(spark, rows) == ordered(expected(rows))
    assert found(spark, []) == []


def test_filters_add_up_like_one(spark):
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2 ** 63, 5000, np.uint64)
    parts = [rng.choice(hashes, 1500) for _ in range(6)]
    filters = []
    for p in parts:
        f = line_dedup.Filters(line_dedup.SEGMENT)
        f.enter(p[:700])
        f.enter(p[700:])
        filters.append((f.seen.tobytes(), f.twice.tobytes()))
    left = line_dedup.added([line_dedup.added(filters[:2]), line_dedup.added(filters[2:])])
    assert left == line_dedup.added(filters)
    kinds, counts = np.unique(np.concatenate(parts), return_counts=True)
    held = line_dedup.holds(np.frombuffer(left[1], np.uint8), line_dedup.probes(kinds, line_dedup.SEGMENT))
    assert held[counts > 1].all() and held[counts == 1].mean() < 0.1


def test_the_query_hashes_what_is_kept(spark):
    from rollbook.llm.queries import op12_line_dedup
    rows = op12_line_dedup(spark, "/root/testdata/sf0.001").collect()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {i: (n, d, sha256(t.encode()).hexdigest()) for i, n, d, t in expected([tuple(r) for r in texts])}
    assert {r[0]: tuple(r)[1:] for r in rows} == want and sum(r["n_dropped"] for r in rows) > 0

import random
import re

import pytest
from odd import ODD, documents, prose
from rollbook.llm import decontaminate as m


def grams(text, n):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def brute(rows, items):
    out = set()
    for doc, text in rows:
        for item, quoted in items:
            n = min(5, len(re.findall(r"[^\W_]+", (quoted or "").lower())))
            if n:
                want = grams(quoted, n)
                shared = len(want & grams(text, n))
                if 100 * shared >= 80 * len(want):
                    out.add((doc, item, shared, len(want)))
    best = {}
    for doc, item, shared, size in out:
        best[doc, item] = max(best.get((doc, item), (0, 0, 0)), (shared / size, shared, size))
    return {(d, i, v[1], v[2]) for (d, i), v in best.items()}


def cases():
    rng = random.Random(6)
    many = [f"v{i}" for i in range(400)]
    items = [(i, prose(rng, rng.randint(1, 70), many)) for i in range(25)] + [(90, None), (91, ""), (92, "?!"), (93, "One, two; THREE"), (3, "second text of item three here it is")]
    rows = []
    for i in range(120):
        words = prose(rng, rng.randint(0, 300), many).split()
        for _ in range(rng.randint(0, 2)):
            quoted = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if quoted:
                    quoted[rng.randrange(len(quoted))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = quoted
        rows.append((100 + i, " ".join(words).upper() if i % 3 else ", ".join(words)))
    return rows + [(100, rows[5][1]), (None, rows[7][1]), (500, "he said one two three")] + ODD, items


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_matches_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(m, "BROADCAST_ROWS", bound)
    rows, items = cases()
    bench = spark.createDataFrame([(i, t, "x", "x") for i, t in items], "item_id long, text string, set string, value string")
    got = m.leaks(documents(spark, rows), bench)
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()} == brute(rows, items)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert m.leaks(documents(spark, ODD), empty).count() == 0
    assert m.leaks(documents(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0

"""Alignment against whole texts tokenized by the libraries and links counted in plain Python."""

import random
from collections import Counter
from hashlib import sha256

import pytest
from odd import ODD, documents, prose

from rollbook.llm import alignment

MORE = [(30, " leading and  double  spaces "), (31, "tabs\tand\nlines \n end "), (32, "a literal ▁ mark"), (33, "<|endoftext|> <s> <0x41> </s>"),
        (34, "don't we'll I'd ''s"), (35, "\U0001d54f 😀😀 ﬁ ① ÀÉ́"), (36, " "), (37, "\n"), (38, "x" * 300 + " y"), (39, "12345 67,890.12 $%&*"),
        (40, "def f(x):\n    return x  # ok\n"), (41, "\x1c \x85 \xa0 　 odd white space"), (42, "东京 是 日本 的 首都。"), (43, "e​f ᠎ g")]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer
    first = Tokenizer.from_file(alignment.BYTE_BPE)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES), alignment.surfaces_a(alignment.BYTE_BPE), alignment.surfaces_b(alignment.PIECES)


def expected(rows, tools):
    first, second, a, b = tools
    told, counts = [], Counter()
    for i, text in rows:
        groups, links, n = [], [], (0, 0)
        if text:
            raw = (" " + text).encode()
            x, y = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            if b"".join(a[t] for t in x) == raw == b"".join(b[t] for t in y):
                n = len(x), len(y)
                ends = lambda ids, s: [sum(len(s[t]) for t in ids[:k + 1]) for k in range(len(ids))] if len(ids) < 50 else list(__import__("itertools").accumulate(len(s[t]) for t in ids))
                ex, ey = ends(x, a), ends(y, b)
                common, p, q = sorted({*ex} & {*ey}), 0, 0
                at_x, at_y = {e: k for k, e in enumerate(ex)}, {e: k for k, e in enumerate(ey)}
                for e in common:
                    groups.append(",".join(map(str, x[p:at_x[e] + 1])) + "|" + ",".join(map(str, y[q:at_y[e] + 1])))
                    links.append((x[at_x[e]], y[at_y[e]]))
                    p, q = at_x[e] + 1, at_y[e] + 1
        counts.update(links)
        told.append((i, *n, len(groups), links, sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = Counter()
    for (_, y), c in counts.items():
        best[y] = max(best[y], c)
    return [(i, x, y, n, len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), digest) for i, x, y, n, links, digest in told]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def found(spark, rows, **how):
    df = alignment.alignment(documents(spark, rows).repartition(3), **how)
    return ordered(tuple(r) for r in df.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_odd_rows_like_whole_texts(spark, tools):
    rows = [*ODD, *MORE, *MORE]
    assert found(spark, rows) == ordered(expected(rows, tools))
    assert found(spark, []) == []


@pytest.mark.parametrize("frequent", [0, 5, alignment.FREQUENT])
def test_commonest_pairs_by_broadcast_and_others_by_join(spark, tools, frequent):
    rng = random.Random(4)
    odd = ["naïvely", "Zürich's", "un-be-liev-able", "antidisestablishment", "東京", "x=1;", "  ", "foo_bar", "\n"]
    rows = [(i, prose(rng, 40) + " " + " ".join(rng.choice(odd) for _ in range(rng.randrange(20)))) for i in range(120)]
    assert found(spark, rows, frequent=frequent) == ordered(expected(rows, tools))


def test_parts_are_independent(tools):
    first, second, *_ = tools
    rng = random.Random(3)
    letters = " \t\n  ᠎\x1c\x85ab'sé▁<s>1 ,.  東́😀ﬁ"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
        parts = alignment.PLACE.split(text)
        assert " ".join(parts) == text
        assert [i for p in parts for i in first.encode(" " + p, add_special_tokens=False).ids] == first.encode(" " + text, add_special_tokens=False).ids
        assert [i for p in parts for i in second.encode(p)] == second.encode(text)


def test_vocabularies(tools):
    first, second, a, b = tools
    assert len(a) == 50257 and len(b) == 32000 and sorted(alignment.byte_letters().values()) == list(range(256))
    same = alignment.identity_map(a, b)
    assert all(b[j] == a[i] for i, j in enumerate(same) if j >= 0) and (same >= 0).sum() > 5000
    raw = "Größe 😀".encode()
    assert b"".join(a[i] for i in first.encode("Größe 😀", add_special_tokens=False).ids) == raw


def test_full_cache_starts_again(tools, monkeypatch):
    _, _, a, b = tools
    monkeypatch.setattr(alignment, "CACHE", 3)
    one = alignment.Aligner(alignment.BYTE_BPE, alignment.PIECES, a, b)
    texts = ["some words here", "other words there", None, "", "some more of them", "some words here"]
    whole = alignment.Aligner(alignment.BYTE_BPE, alignment.PIECES, a, b).align(texts)
    for text, want in zip(texts, whole):
        got = one.align([text])[0]
        assert got[:3] == want[:3] and got[3].tolist() == want[3].tolist()

import random
import struct

import numpy as np
import pytest
from odd import ODD, documents, prose
from rollbook.llm import pieces as m


@pytest.fixture(scope="module")
def loaded():
    return m.load_pieces()


@pytest.fixture(scope="module")
def model(loaded):
    return m.Model(m.prepare(loaded))


def best_score(model, loaded, segment):
    """The largest sum of scores over all ways to cut a segment, by plain dynamic programming."""
    scores = {p: s for p, s, ok in zip(loaded["pieces"], loaded["scores"], loaded["plain"]) if ok}
    best = [0.0] + [-np.inf] * len(segment)
    for end in range(1, len(segment) + 1):
        for begin in range(max(0, end - 20), end):
            s = scores.get(segment[begin:end], model.unknown_score if end - begin == 1 else -np.inf)
            best[end] = max(best[end], best[begin] + s)
    return best[-1]


def test_paths_are_the_best(model, loaded):
    rng = random.Random(2)
    alphabet = "abcdethino▁.,é日😀\n"
    segments = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(200)] + ["▁the", "▁▁▁▁", "a"]
    back = {i: b for b, i in loaded["bytes"].items()}
    for segment, ids in zip(segments, model.cut(segments)):
        total, unknown = 0.0, bytearray()
        for i in np.frombuffer(ids, np.int32).tolist():
            if i in back:
                unknown.append(back[i])
            else:
                total += loaded["scores"][i]
        total += len(unknown.decode("utf-8")) * model.unknown_score
        assert total == pytest.approx(best_score(model, loaded, segment))


def test_long_segments_are_cut_like_short_ones(model, monkeypatch):
    rng = random.Random(7)
    segments = ["".join(rng.choice("abcdethino▁.,é日😀\n") for _ in range(n)) for n in (1, 2, 16, 17, 40, 333, 900)] + ["x" * 500, "日" * 50, "the" * 40, "▁" * 300]
    whole = model.cut(segments)
    for stretch in (1, 7, 50, 100_000):
        monkeypatch.setattr(m, "STRETCH", stretch)
        assert [model.cut_alone(s) for s in segments] == whole


def test_parts_of_a_batch_change_nothing(model, monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(60)) + "x" * rng.choice([0, 0, 250, 1000]) for _ in range(60)] + [None, "", " "]
    one_by_one = [model.encoder()([t])[0].tolist() for t in texts]
    for together, alone, kept in ((1, 200, 400_000), (500, 3, 10), (1_000_000, 10_000, 0)):
        for name, value in (("TOGETHER", together), ("ALONE", alone), ("CACHE", kept)):
            monkeypatch.setattr(m, name, value)
        encode = model.encoder()
        assert [x.tolist() for part in (texts[:30], texts[30:]) for x in encode(part)] == one_by_one


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def fields(raw):
    at = 0
    while at < len(raw):
        begin, numbers = at, []
        for _ in range(2):
            shift = value = 0
            while True:
                value |= (raw[at] & 127) << shift
                shift, at = shift + 7, at + 1
                if raw[at - 1] < 128:
                    break
            numbers.append(value)
            if len(numbers) == 1 and value & 7 == 5:
                numbers.append(None)
                break
        key, value = numbers
        body = b""
        if key & 7 == 2:
            body, at = raw[at:at + value], at + value
        elif key & 7 == 5:
            body, at = raw[at:at + 4], at + 4
        yield key >> 3, raw[begin:at], body


def as_unigram(path, scores):
    """The model file with these scores and the unigram type."""
    out, i = b"", 0
    for field, whole, body in fields(open(path, "rb").read()):
        if field == 1:
            body = b"".join(w for f, w, _ in fields(body) if f != 2) + b"\x15" + struct.pack("<f", scores[i])
            whole, i = b"\x0a" + varint(len(body)) + body, i + 1
        elif field == 2:
            body = b"".join(w for f, w, _ in fields(body) if f != 3) + b"\x18\x01"
            whole = b"\x12" + varint(len(body)) + body
        out += whole
    return out


def test_agrees_with_the_library_on_a_unigram_model(model, loaded):
    """Same ids as the library's unigram mode, but for equal sums (runs of one sign cut elsewhere)."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_proto=as_unigram(m.MODEL, loaded["scores"]))
    rng = random.Random(4)
    syllables = "the tion ing er on an re he in ed nd ha és ñ ción ß ung".split()
    texts = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))).join([" ", "."]) + " " + prose(rng, 30) for _ in range(200)]
    texts += ["  two  spaces ", "line\nends\n\n", "日本 😀\t\x01", "ab" * 2000, "", "a"]
    for text, got in zip(texts, model.encoder()(texts)):
        assert got.tolist() == library.encode(text), text


def test_ties_take_the_longer_last_piece(loaded):
    few = {"pieces": ["<unk>", "a", "aa", m.MARK], "scores": np.array([0.0, -1.5, -1.5, -1.5]), "plain": np.array([False, True, True, True]), "bytes": {}, "unknown": 0}
    tiny = m.Model(m.prepare(few))
    assert [np.frombuffer(x, np.int32).tolist() for x in tiny.cut(["aaa", "aaaa", "b", "ab"])] == [[1, 2], [2, 2], [0], [1, 0]]
    assert tiny.decode(np.array([3, 1, 2])) == "aaa"


def test_ranks_become_log_scores():
    plain = np.array([False, True, True, True])
    got = m.log_scores(np.array([0.0, -2.0, 0.0, -1e9]), plain)
    assert got[2] > got[1] > got[3] and np.exp(got[1:]).sum() == pytest.approx(1) and got[0] == 0
    kept = np.array([0.0, -1.25, -2.5, -3.0])
    assert m.log_scores(kept, plain) is kept


def test_round_trip_and_odd_rows(spark):
    docs = documents(spark, ODD)
    coded = m.encode(docs)
    rows = coded.select("row.doc_id", "row.text", "ids", "n_tokens", "round_trip").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r.text is None:
            assert r.ids is None and r.n_tokens is None and r.round_trip is None
        else:
            assert r.n_tokens == len(r.ids) and (r.text == "") == (r.n_tokens == 0) and r.round_trip == (m.MARK not in r.text)
    again = m.decode(coded.select("row.doc_id", "row.text", "ids")).select("row.text", "text").toDF("before", "after").collect()
    assert all(r.after == (r.before and r.before.replace(m.MARK, " ")) for r in again)
    assert m.encode(documents(spark, [])).count() == 0

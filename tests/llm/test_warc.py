import base64
import hashlib
import struct

import pytest
import zstandard
from rollbook.llm import warc

PAGES = "page_id long, url string, html string, row string, payload string"


def expected(pages):
    by = {}
    for i, _, html, *_ in pages:
        p = (html or "").encode()
        by[p] = max(by.get(p, i), i)
    out = []
    for i, _, html, *_ in pages:
        p = (html or "").encode()
        last = by[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == last else "revisit", None if i == last else last))
    return sorted(out)


def test_round_trip(spark):
    pages = [(i, f"http://a/{i}", f"<p>page {i % 7}</p>" * (i % 5), "x", "x") for i in range(60)]
    pages += [(100, None, None, "x", "x"), (101, "http://b\r\nX: y", "", "x", "x"), (102, "u", "é\r\n\r\nWARC/1.1\r\n" * 30_000, "x", "x"), (5, "http://a/5", "<p>page 5</p>" * 0, "x", "x")]
    got = warc.round_trip(spark.createDataFrame(pages, PAGES)).collect()
    assert all(r.error is None for r in got)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(pages)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_smaller_payloads_are_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab", "x", "x"), (2, "u", "ab", "x", "x"), (3, "u", "abc", "x", "x"), (4, "u", "abc", "x", "x")], PAGES)
    folder = f"file://{tmp_path}/small"
    (tmp_path / "small").mkdir()
    assert sum(r.records for r in warc.write_pages(pages, folder, min_bytes=3).collect()) == 4
    got = {r.record_id: (r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in warc.read_archives(spark, folder).collect()}
    assert got["urn:page:1"] == ("response", None, b"ab") and got["urn:page:2"] == ("response", None, b"ab")
    assert got["urn:page:3"] == ("revisit", "urn:page:4", None) and got["urn:page:4"] == ("response", None, b"abc")


def records(n=40):
    return [warc.record_bytes(f"urn:page:{i}", "http://a", "2024-01-01T00:00:00Z", f"<p>{'text of a page ' * 20}{i}</p>".encode(), None) for i in range(n)]


def test_archive_has_dictionary_and_one_frame_per_record(tmp_path):
    ((path, n, size),) = warc.write_archives(records(), f"file://{tmp_path}", "a")
    raw = open(path, "rb").read()
    assert n == 40 and size == len(raw) and raw[:4] == warc.DICTIONARY_MAGIC
    found = list(warc.frames(memoryview(raw)))
    assert [f[1] for f in found] == records() and all(f[2] is None for f in found)
    # A dictionary that is not compressed reads the same.
    (length,) = struct.unpack("<I", raw[4:8])
    plain = zstandard.ZstdDecompressor().decompressobj().decompress(raw[8:8 + length])
    again = warc.DICTIONARY_MAGIC + struct.pack("<I", len(plain)) + plain + raw[8 + length:]
    assert [f[1] for f in warc.frames(memoryview(again))] == records()


def test_archives_roll_over(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1500)
    monkeypatch.setattr(warc, "TRAIN_RECORDS", 5)
    made = list(warc.write_archives(records(30), f"file://{tmp_path}", "a"))
    assert len(made) > 1 and sum(m[1] for m in made) == 30


@pytest.mark.parametrize("damage, said", [
    (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), "version"),
    (lambda r: r.replace(b"Content-Length: ", b"Content-Length: 9", 1), "Content-Length"),
    (lambda r: r.replace(b"text of", b"test of"), "block digest"),
    (lambda r: r.replace(b"WARC-Date", b"X-Date"), "missing header warc-date"),
    (lambda r: r[:-2], "Content-Length"),
    (lambda r: r.replace(b"WARC-Date:", b"WARC-Type: x\r\nWARC-Date:"), "repeated header"),
])
def test_bad_records_are_told(damage, said):
    assert said in warc.parse_record(damage(records(1)[0]))["error"]


def test_damaged_archive(spark, tmp_path):
    ((path, _, _),) = warc.write_archives(records(), f"file://{tmp_path}", "a")
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[:-20])
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert len(got) == 40 and sum(r.error is None for r in got) == 39
    assert next(iter(warc.frames(memoryview(warc.DICTIONARY_MAGIC + b"\x10"))))[2].startswith("dictionary")


@pytest.mark.parametrize("n", [0, 3])
def test_a_record_too_long_does_not_hide_those_behind_it(tmp_path, monkeypatch, n):
    monkeypatch.setattr(warc, "MAX_RECORD", 200_000)
    records = [warc.record_bytes(f"urn:r:{i}", "http://x", "2024-01-01T00:00:00Z", b"p" * (500_000 if i == n else 10 + i), None) for i in range(5)]
    (path, count, _), = warc.write_archives(records, str(tmp_path), "a")
    found = list(warc.frames(memoryview(open(path, "rb").read())))
    assert count == len(found) == 5 and len({offset for offset, _, _ in found}) == 5
    assert [error for _, _, error in found] == ["frame: record too long" if i == n else None for i in range(5)]
    assert [raw for _, raw, _ in found] == [None if i == n else r for i, r in enumerate(records)]

"""WARC archives with one Zstandard frame per record and a leading dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary, itself possibly compressed; then each record is one frame.  Writers
train the dictionary on the first records of the archive.  Readers decode frame by
frame and check version, headers, lengths and digests; what fails is reported in
``error`` and never silently skipped.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.base import shared_path

DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed once it holds this many bytes, so that a reader's task stays small.
ARCHIVE_BYTES = 32_000_000
#: Records and bytes at the head of an archive on which its dictionary is trained, and its size.
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 200, 1_000_000, 16_384
LEVEL = 3
CHUNK = 1 << 16
#: Bytes of a record that a task can hold: a row of Spark takes no more either.
MAX_RECORD = 1 << 30

RECORD = ("archive string, offset long, record_id string, record_type string, target_uri string, warc_date string, "
          "payload_digest string, payload_bytes long, refers_to string, payload binary, error string")
RECORD_COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, uri: str, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit that keeps only the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>"),
            ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
            ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block)))]
    if refers_to is not None:
        head[4:4] = [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary, or None where the samples are too few or too small for one."""
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:
        return None


def write_archives(records: Iterable[bytes], folder: str, stem: str) -> Iterator[tuple[str, int, int]]:
    """Write archives ``<stem>-<n>.warc.zst``; yields (path, records, bytes) of each.

    Each is written under another name and renamed when whole, so that a lost or repeated
    task leaves no half archive; names do not depend on the attempt.
    """
    store, root = fs.FileSystem.from_uri(folder)
    records, n = iter(records), 0
    while head := list(islice(records, 1)):
        size = len(head[0])
        while len(head) < TRAIN_RECORDS and size < TRAIN_BYTES and (more := next(records, None)) is not None:
            head.append(more)
            size += len(more)
        dictionary = train(head)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
        name, count, written = f"{root}/{stem}-{n:05d}.warc.zst", 0, 0
        partial = f"{name}.{hashlib.sha1(head[0]).hexdigest()[:8]}.{id(press):x}.partial"
        with store.open_output_stream(partial) as out:
            if dictionary is not None:
                body = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
                out.write(DICTIONARY_MAGIC + struct.pack("<I", len(body)) + body)
                written += 8 + len(body)
            for record in chain(head, records):
                frame = press.compress(record)
                out.write(frame)
                count, written = count + 1, written + len(frame)
                if written >= ARCHIVE_BYTES and count >= len(head):
                    break
        store.move(partial, name)
        yield name, count, written
        n += 1


def read_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary in the leading skippable frame, if there is one, and where frames begin."""
    if bytes(data[:4]) != DICTIONARY_MAGIC:
        return None, 0
    if len(data) < 8:
        raise ValueError("dictionary frame cut short")
    (size,) = struct.unpack("<I", data[4:8])
    body = bytes(data[8:8 + size])
    if len(body) < size:
        raise ValueError("dictionary frame cut short")
    if body[:4] == FRAME_MAGIC:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return zstandard.ZstdCompressionDict(body), 8 + size


def frames(data: memoryview) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, decoded frame, error) of each frame; after damage the rest is one error.

    A record of more than MAX_RECORD bytes is one error and none of it is held; the frames
    behind it are read.
    """
    try:
        dictionary, at = read_dictionary(data)
    except (ValueError, zstandard.ZstdError) as e:
        yield 0, None, f"dictionary: {e}"
        return
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        begin, parts, size, one = at, [], 0, unpack.decompressobj()
        try:
            if bytes(data[at:at + 4]) != FRAME_MAGIC:
                raise ValueError("no frame starts here")
            while not one.eof:
                piece = data[at:at + CHUNK]
                if not len(piece):
                    raise ValueError("frame cut short")
                parts.append(one.decompress(piece))
                size += len(parts[-1])
                if size > MAX_RECORD:
                    parts.clear()
                at += len(piece) - (len(one.unused_data) if one.eof else 0)
        except (ValueError, zstandard.ZstdError) as e:
            yield begin, None, f"frame: {e}"
            return
        if size > MAX_RECORD:
            yield begin, None, "frame: record too long"
        else:
            yield begin, b"".join(parts), None


def parse_record(raw: bytes) -> dict:
    """The fields of one record; ``error`` says what is wrong with it, None if nothing."""
    out = dict.fromkeys(RECORD_COLUMNS)
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return out | {"error": "no WARC version line or header end"}
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return out | {"error": "header line without colon"}
        if name.strip().lower() in fields:
            return out | {"error": f"repeated header {name.strip()}"}
        fields[name.strip().lower()] = value.strip()
    out |= {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id", "").strip("<>") or None,
            "target_uri": fields.get("warc-target-uri"), "warc_date": fields.get("warc-date"),
            "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
            "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    missing = [h for h in ("warc-type", "warc-record-id", "warc-date", "content-length") if not fields.get(h)]
    if missing:
        return out | {"error": f"missing header {missing[0]}"}
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        return out | {"error": "bad Content-Length"}
    length = int(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) < length or end != b"\r\n\r\n":
        return out | {"error": "Content-Length does not match the record"}
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest_of(block)}":
        return out | {"error": "block digest does not match"}
    if out["record_type"] not in ("response", "revisit") or "application/http" not in fields.get("content-type", ""):
        return out | {"payload": block, "payload_bytes": length}
    http, gap, payload = block.partition(b"\r\n\r\n")
    sizes = [v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"]
    if not gap or len(sizes) != 1 or not sizes[0].isdigit():
        return out | {"error": "bad HTTP header"}
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": int(sizes[0]), "error": None if out["refers_to"] and out["payload_digest"] else "revisit without target"}
    wrong = "payload length does not match" if int(sizes[0]) != len(payload) else None
    if out["payload_digest"] and digest_of(payload) != out["payload_digest"]:
        wrong = "payload digest does not match"
    return out | {"payload": payload, "payload_bytes": len(payload), "error": wrong}


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives ``*.warc.zst`` in a folder any Spark reader reaches.

    An archive is one task's input.  Damaged records and the rest of a damaged archive come
    as rows with ``error``.  An empty folder gives no rows.
    """
    files = (spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
             .option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content"))

    schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in RECORD.split(", ")])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for offset, raw, error in frames(memoryview(content.as_buffer())):
                    row = parse_record(raw) if error is None else dict.fromkeys(RECORD_COLUMNS) | {"error": error}
                    row |= {"archive": path.as_py(), "offset": offset}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(decode, RECORD)


def originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the rows that revisit another one with the same payload.

    Equal payloads are found by SHA-256; of those of at least ``min_bytes`` the largest
    page_id is the original.  Only ids and digests are shuffled, counts first, so that one
    payload may be shared by any share of the rows.
    """
    ids = pages.select("page_id", F.sha2("payload", 256).alias("sha")).where(F.octet_length("payload") >= min_bytes)
    first = ids.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
    shared = first.where("refers_to > least").select("sha", "refers_to")
    return ids.join(shared, "sha").where("page_id < refers_to").distinct()


def write_pages(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html); returns the manifest
    (archive, records, bytes) of what was written, one row per archive.

    Null html counts as empty, a null url as an empty one.  Rows are dealt by page_id and
    sorted, so that a repeated task writes the same archives.  Equal rows give equal records.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    links = originals(rows, min_bytes).select(F.col("page_id").alias("link_id"), F.col("sha").alias("link_sha"), "refers_to")
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    joined = (rows.join(links, F.col("page_id").eqNullSafe(F.col("link_id")) & (F.col("sha") == F.col("link_sha")), "left")
              .select("page_id", "url", "payload", "refers_to").sortWithinPartitions("page_id", "url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    yield record_bytes(page_urn(page), url, date, payload, None if refers is None else page_urn(refers))

        done = list(write_archives(records(), folder, f"part-{TaskContext.get().partitionId():06d}"))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done]) for i in range(3)], ["archive", "records", "bytes"])

    return joined.mapInArrow(write, "archive string, records long, bytes long")


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder, then read them back from there."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    if "://" not in folder:  # Hadoop writes file:/a, Arrow wants file:///a
        folder = "file://" + folder.removeprefix("file:")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    # The write has effects outside Spark's data flow, so it runs once, here; its manifest is kept beside.
    write_pages(pages, folder).write.parquet(f"{folder}-manifest")
    records = read_archives(spark, folder, payloads=False)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return records.select(
        as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        as_id("refers_to").alias("refers_to"), "error")

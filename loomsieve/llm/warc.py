"""WARC archives whose records are compressed one by one with a shared dictionary.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary built from its own records; every record follows as a frame of its own, so
it can be read alone, given the dictionary. A digest aggregate, combined on the map
side, finds the page of each payload that is the response; all other pages with that
payload become revisit records. Pages meet their digest's decision in one join.

Archives are written and read through Arrow's file systems (local, hdfs, s3, gs), so the
folder may lie wherever all executors reach it.

A null html is an empty payload. A null page_id stays null: such a page revisits the page
of its payload with the largest page_id, and is a response where no page has one. Repeated rows of the largest page_id of a payload
(same page_id, same payload) are each a response. An empty table gives no archive and
no rows. Columns other than page_id, url and html don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.llm import scan
from loomsieve.session import cut, shared_dir, stored

MAGIC = 0x184D2A5D
#: Bytes of dictionary, and bytes of records (evenly spread over the archive) it is built from.
DICTIONARY, TRAINING = 64 << 10, 4 << 20
#: Bytes of payload an archive is cut at.
ARCHIVE = 32 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    uri = path.replace("s3a://", "s3://", 1) if "://" in path else os.path.abspath(path.removeprefix("file:"))
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id if page_id is not None else 'none'}>",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[3:3] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """Empty where there is too little to learn from."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAINING))
    some = [r[: TRAINING // 8] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY, some, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(path: str, records: list[bytes]) -> list[tuple[int, int]]:
    """(offset, length) of each record's frame. The file appears under its name when complete."""
    raw = build_dictionary(records)
    to = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_content_size=True, write_checksum=True)
    places, at = [], 8 + len(raw)
    system, path = located(path)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(struct.pack("<II", MAGIC, len(raw)) + raw)
        for r in records:
            frame = to.compress(r)
            f.write(frame)
            places.append((at, len(frame)))
            at += len(frame)
    system.move(part, path)
    return places


def read_archive(path: str):
    """(headers, payload) of each record in order; payload of a revisit is empty."""
    system, place = located(path)
    with system.open_input_file(place) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != MAGIC:
            raise ValueError(f"{path}: no leading dictionary frame")
        raw = f.read(size)
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
        rest = f.read()
    at = 0
    while at < len(rest):
        d = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        data = d.decompress(memoryview(rest)[at:])
        at = len(rest) - len(d.unused_data)
        head, _, body = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, body[: int(fields["Content-Length"])]


def read_record(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place."""
    system, place = located(path)
    with system.open_input_file(place) as f:
        _, size = struct.unpack("<II", f.read(8))
        raw = f.read(size)
        f.seek(offset)
        data = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None).decompress(f.read(length))
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])]


def decisions(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(sha, top) of payloads that occur more than once: the largest page_id."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).alias("n"))
    return keyed.where(F.col("n") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "top")


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes the archives; one row each: (path, n_records, n_bytes)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"), F.unhex(F.sha1(payload.cast("binary"))).alias("sha"))
    # written out, so that few decisions are broadcast by their known size and pages aren't shuffled
    rows = rows.join(stored(decisions(pages, least_bytes), "decisions"), "sha", "left")

    def run(batches):
        held: list[tuple[int | None, str, bytes, bytes, int | None]] = []
        size = 0

        def flush():
            held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[3]))
            made = [record(i, url, body, base64.b32encode(sha).decode(), None if top is None or top == i else top) for i, url, body, sha, top in held]
            system, target = located(folder)
            system.create_dir(target, recursive=True)
            name = hashlib.sha1(b"".join(b"%r " % r[0] + r[3] for r in held)).hexdigest()
            path = f"{folder}/{name}.warc.zst"
            places = write_archive(path, made)
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(made)], "n_bytes": [places[-1][0] + places[-1][1]]})

        for b in scan.chunks(batches, "html", 4 << 20):
            page, url, html, sha, top = (scan.column(b, c).to_pylist() for c in ("page_id", "url", "html", "sha", "top"))
            for i, u, t, s, k in zip(page, url, html, sha, top):
                body = t.encode("utf-8", "surrogatepass")
                held.append((i, u, body, s, k))
                size += len(body)
            if size > ARCHIVE:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    return rows.select("page_id", "url", "html", "sha", "top").mapInArrow(run, "path string, n_records long, n_bytes long")


def read(spark: SparkSession, archives: DataFrame, parts: int | None = None) -> DataFrame:
    """Parses archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""

    def number(urn: str) -> int | None:
        n = urn.removeprefix("<urn:page:").rstrip(">")
        return None if n == "none" else int(n)

    def run(batches):
        for b in batches:
            for path in scan.column(b, "path").to_pylist():
                out = []
                for fields, body in read_archive(path):
                    revisit = fields["WARC-Type"] == "revisit"
                    n, sha = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and (len(body) != n or digest(body) != sha):
                        raise ValueError(f"{path}: damaged record {fields['WARC-Record-ID']}")
                    out.append((number(fields["WARC-Record-ID"]), n, sha, fields["WARC-Type"], number(fields["WARC-Refers-To"]) if revisit else None, fields["WARC-Target-URI"]))
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    spread = archives.select("path").repartition(parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes and reads back."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read(spark, cut(write(pages, folder, least_bytes)))

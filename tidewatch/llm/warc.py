"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole records; a skippable frame with the
record index (record id -> frame number, offset inside the frame); and the seekable format's footer table,
again a skippable frame, so that any decoder reads the bundle as plain WARC. Bundles are kept as rows of a
Parquet table in the shared folder: Spark's commit makes them whole or absent when executors are lost.

Pages with equal payloads of at least `min_revisit` bytes share one response, the one with the largest
page_id; the others become revisit records that point to it. Only digests are grouped (map-side combined), and the
join that brings the group's response back is a plain sort-merge join, which AQE splits where a payload is hot.

Defined cases: null html is an empty payload; a null url leaves the target header out; a null page_id never is
a response of a group that has ids; rows repeated with the group's largest page_id are each a response; an empty
table gives no bundle and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._io import kept

_SKIPPABLE_INDEX, _SKIPPABLE_SEEK, _SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_ID_SPACE = 0x7469646577617463 << 64
_NO_ID = "urn:uuid:00000000-0000-0000-0000-000000000000"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 23


def record_id(page_id: int | None) -> str:
    return _NO_ID if page_id is None else f"urn:uuid:{uuid.UUID(int=_ID_SPACE | page_id & (1 << 64) - 1)}"


def page_of(record: str) -> int | None:
    if record == _NO_ID:
        return None
    low = uuid.UUID(record.removeprefix("urn:uuid:")).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and the digest of the payload but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if is_revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers with small-letter names, block, offset of the next record) of the record at `at`."""
    data = bytes(data) if not isinstance(data, bytes) else data
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at offset {at}")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    begin, size = stop + 4, int(headers["content-length"])
    if data[begin + size : begin + size + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at offset {at} is cut")
    return headers, data[begin : begin + size], begin + size + 4


class BundleWriter:
    """Groups records into frames; `finish` appends the record index and the seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.coder = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int]] = []
        self.open, self.size, self.total = [], 0, 0

    def add(self, name: str, record: bytes) -> None:
        self.index.append((name, len(self.frames), self.size))
        self.open.append(record)
        self.size += len(record)
        self.total += len(record)
        if self.size >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            frame = self.coder.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.size))
            self.open, self.size = [], 0

    def finish(self) -> bytes:
        self._close()
        index = zstandard.ZstdCompressor().compress(json.dumps(self.index).encode())
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEK_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", _SKIPPABLE_INDEX, len(index)), index, struct.pack("<II", _SKIPPABLE_SEEK, len(table)), table])


class BundleReader:
    """Random access to a bundle through its seek table and record index."""

    def __init__(self, data: bytes):
        count, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != _SEEK_MAGIC:
            raise ValueError("no seek table")
        table = len(data) - 9 - 8 * count
        self.data, self.starts, self.sizes, at = data, [], [], 0
        for i in range(count):
            packed, plain = struct.unpack("<II", data[table + 8 * i : table + 8 * i + 8])
            self.starts.append((at, packed))
            self.sizes.append(plain)
            at += packed
        kind, size = struct.unpack("<II", data[at : at + 8])
        if kind != _SKIPPABLE_INDEX:
            raise ValueError("no record index")
        self.index = [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + size]))]
        self.coder = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        at, packed = self.starts[i]
        return self.coder.decompress(self.data[at : at + packed], max_output_size=self.sizes[i])

    def record(self, name: str) -> tuple[dict[str, str], bytes]:
        """The record by its id: one frame is decompressed."""
        frame, offset = next((f, o) for n, f, o in self.index if n == name)
        headers, block, _ = parse_record(self.frame(frame), offset)
        return headers, block

    def records(self) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
        """Every record through the index: (id, frame, offset, headers, block)."""
        held, data = -1, b""
        for name, frame, offset in self.index:
            if frame != held:
                held, data = frame, self.frame(frame)
            headers, block, _ = parse_record(data, offset)
            yield name, frame, offset, headers, block


BUNDLES = "bundle string, records bigint, bytes bigint, data binary"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, bundle string, frame bigint, frame_offset bigint"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made, writer = TaskContext.get().partitionId(), 0, BundleWriter()

    def flush(w: BundleWriter, n: int) -> pa.RecordBatch:
        data = w.finish()
        return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}"]), pa.array([len(w.index)], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["bundle", "records", "bytes", "data"])

    for batch in batches:
        ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
        for page_id, url, html, refers_to, revisit in zip(ids, urls, batch.column(2), refers, batch.column(4).to_pylist(), strict=True):
            payload = html.as_py().encode() if html.is_valid else b""
            writer.add(record_id(page_id), make_record(page_id, url, payload, refers_to, revisit))
            if writer.total >= BUNDLE_BYTES:
                yield flush(writer, made)
                made, writer = made + 1, BundleWriter()
    if writer.index:
        yield flush(writer, made)


def write_bundles(pages: DataFrame, min_revisit: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The bundle table of all pages, as written to the shared folder."""
    slim = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    keyed = slim.withColumn("n", F.octet_length(F.coalesce("html", F.lit("")))).withColumn("digest", F.when(F.col("n") >= min_revisit, F.sha1(F.col("html").cast("binary"))))
    shared = keyed.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("copies"), F.max("page_id").alias("response")).where("copies > 1").select(F.col("digest").alias("key"), "response")
    shared = kept(shared, "warc-shared")  # stored, so the planner knows its size: while that is small no page is shuffled
    # pages without a digest meet nobody; each has a key of its own, so they don't meet in one task either
    own = F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    ready = keyed.withColumn("key", own).join(shared, "key", "left").select("page_id", "url", "html", F.col("response").alias("refers_to"), (F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))).alias("is_revisit"))
    return kept(ready.mapInArrow(_write, BUNDLES), "warc-bundles", compression="uncompressed")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bundle", pa.string()), ("frame", pa.int64()), ("frame_offset", pa.int64())])
    for batch in batches:
        for bundle, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for name, frame, offset, headers, block in BundleReader(data.as_py()).records():
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                kind = headers["warc-type"]
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{bundle}: the payload of {name} does not match its digest")
                target = headers.get("warc-refers-to")
                rows.append((page_of(name), size, digest, kind, page_of(target.strip("<>")) if target else None, bundle, frame, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """One row per record of the bundles, payloads verified against their digests."""
    return bundles.select("bundle", "data").mapInArrow(_read, READ)

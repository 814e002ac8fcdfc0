"""MPEG audio columns: frame parsing that survives junk, and a lossless carrier for byte payloads.

`parse` walks any MPEG-1/2/2.5 stream: it skips and reads tags, finds frame headers again after junk
or damage (a header counts only if another of its kind, a tag or the end stands where it says), reads a
Xing/Info or VBRI table, verifies CRC-16 words, and gives exact sample counts and frame offsets.

`encode` puts a payload of 192-byte units into Layer III frames at 48 kHz mono: the side information
says that the granules are empty, so players hear silence, and the units lie in the frames' main data.
Frames of 80, 160 and 320 kbit/s carry 1, 2 and 4 units, so the stream has a variable bitrate and a Xing
table with a seek index. Bytes of the payload are stored as they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._io import kept

UNIT = 192

#: Fixed values of the format: kbit/s by header index for MPEG-1 layers I, II, III, then MPEG-2 layers I, and II or III.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
SAMPLE_RATES = [44100, 48000, 32000]


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 25 for 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int
    side: int  # bytes of side information, 0 but for layer III


def read_header(b: bytes, at: int) -> Header | None:
    """The frame header at `at`, or None if the four bytes can't be one."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    version = {0: 25, 2: 2, 3: 1}.get(b[at + 1] >> 3 & 3)
    layer = 4 - (b[at + 1] >> 1 & 3)
    index, rate_index = b[at + 2] >> 4, b[at + 2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate_index == 3:
        return None
    kbps = BITRATES[(1 if version == 1 else 2, layer)][index]
    rate = SAMPLE_RATES[rate_index] // {1: 1, 2: 2, 25: 4}[version]
    pad, mono = b[at + 2] >> 1 & 1, b[at + 3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    length = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return Header(version, layer, not b[at + 1] & 1, kbps, rate, mono, length, samples, side)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=4096)  # few frame heads differ
def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 of the first `bits` bits of data, or of all."""
    c, whole = 0xFFFF, len(data) if bits is None else bits // 8
    for x in data[:whole]:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ x]
    for k in range(0 if bits is None else bits % 8):
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ (data[whole] >> (7 - k) & 1) else 0)
    return c


#: Fixed values of the format: bits of a layer II allocation per subband, as (bits, subbands); "low" is for half sample rates.
ALLOCATION_BITS = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19))}


def _allocation(h: Header) -> list[int]:
    each = h.kbps if h.mono else h.kbps // 2
    if h.version != 1:
        kind = "low"
    elif each <= 48:
        kind = "d" if h.rate == 32000 else "c"
    else:
        kind = "a" if h.rate == 48000 or each <= 80 else "b"
    return [bits for bits, n in ALLOCATION_BITS[kind] for _ in range(n)]


def checksum_holds(frame: bytes, h: Header) -> bool:
    """Whether a protected frame's CRC word is that of its header and of what its layer protects: side information in layer III,
    allocations in layer I, allocations and scale factor selections in layer II."""
    channels, body = 1 if h.mono else 2, frame[6:]
    if h.layer == 3:
        n = 8 * h.side
    else:
        wide = 32 if h.layer == 1 else len(_allocation(h))
        bound = min(wide, 4 * (frame[3] >> 4 & 3) + 4) if frame[3] >> 6 == 1 else wide  # above it channels share allocations
        if h.layer == 1:
            n = 4 * (channels * bound + wide - bound)
        else:
            bits, n, used = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 0, 0
            for band, size in enumerate(_allocation(h)):
                for _ in range(channels if band < bound else 1):
                    used += (bits >> (512 - n - size) & ((1 << size) - 1) != 0) * (1 if band < bound else channels)
                    n += size
            n += 2 * used
    if 8 * len(body) < n:
        return False
    return crc16(frame[2:4] + body[: -(-n // 8)], 16 + n) == int.from_bytes(frame[4:6], "big")


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    crc_checked: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)

    def offset_at(self, seconds: float) -> int | None:
        """The byte offset of the frame that plays at `seconds`."""
        if not self.offsets:
            return None
        k = int(seconds * self.rate // self.headers[0].samples)
        return self.offsets[min(max(k, 0), len(self.offsets) - 1)]


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _read_id3v2(b: bytes, out: Stream) -> int:
    if b[:3] != b"ID3" or len(b) < 10:
        return 0
    end, at, major, flags = 10 + _syncsafe(b[6:10]), 0, b[3], b[5]
    b = b[10:end]
    if flags & 0x80 and major < 4:  # a zero byte was put behind every 255
        b = b.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and len(b) >= 4:  # an extended header stands first
        at = _syncsafe(b) if major == 4 else 4 + int.from_bytes(b[:4], "big")
    while major >= 3 and at + 10 <= len(b) and b[at]:
        size = _syncsafe(b[at + 4 : at + 8]) if major == 4 else int.from_bytes(b[at + 4 : at + 8], "big")
        name, body = b[at : at + 4].decode("latin-1"), b[at + 10 : at + 10 + size]
        if major == 4 and b[at + 9] & 2:
            body = body.replace(b"\xff\0", b"\xff")
        if name[:1] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            out.tags[key] = value.rstrip("\0")
        at += 10 + size
    return end


def _read_table(frame: bytes, h: Header) -> dict[str, object]:
    at = 4 + h.side + (2 if h.protected and frame[4 + h.side : 8 + h.side] not in (b"Xing", b"Info") else 0)
    if frame[at : at + 4] in (b"Xing", b"Info"):
        out: dict[str, object] = {"kind": frame[at : at + 4].decode()}
        flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            out["toc"] = list(frame[at : at + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, _, size, frames, entries, scale, width, per = struct.unpack(">HHHIIHHHH", frame[40:62])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": toc, "frames_per_entry": per}
    return {}


def parse(b: bytes) -> Stream:
    """Everything that the stream says; an empty or foreign byte string gives a stream of no frames."""
    out = Stream()
    at = _read_id3v2(b, out)
    end = len(b)
    if b[end - 128 : end - 125] == b"TAG" and end >= 128:
        end -= 128
        out.tags["id3v1"] = b[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    lost = False
    while at < end - 3:
        h = read_header(b, at)
        ok = h is not None and at + h.length <= end
        if ok and (lost or not out.headers):  # a header is believed if another of its kind follows, or nothing does
            after = read_header(b, at + h.length)
            ok = at + h.length == end or after is not None and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate)
        if ok and out.headers:
            ok = (h.version, h.layer, h.rate) == (out.headers[0].version, out.headers[0].layer, out.headers[0].rate)
        if not ok:
            lost = True
            at = b.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        out.resyncs += lost
        lost = False
        if not out.headers and not out.table:
            out.table = _read_table(b[at : at + h.length], h)
            if out.table:
                at += h.length
                continue
        if h.protected:
            out.crc_checked += 1
            out.crc_bad += not checksum_holds(b[at : at + h.length], h)
        out.offsets.append(at)
        out.headers.append(h)
        out.samples += h.samples
        out.rate = h.rate
        at += h.length
    return out


#: kbit/s of the carrier's frames and the units in each; 4 + 2 + 17 bytes stand before a frame's main data.
CARRIER = {320: 4, 160: 2, 80: 1}
_BODY = 23


def _carrier_header(kbps: int, protected: bool = True) -> bytes:
    return bytes([0xFF, 0xFA if protected else 0xFB, BITRATES[(1, 3)].index(kbps) << 4 | 1 << 2, 0xC0])


_LEAD = {k: (h := _carrier_header(k)) + crc16(h[2:] + bytes(17)).to_bytes(2, "big") + bytes(17) for k in CARRIER}


def padded(text: bytes) -> bytes:
    """`text` with spaces up to a positive multiple of the unit."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The stream that carries `payload` (a positive multiple of the unit); a tag holds the unpadded size."""
    units, left, at = len(payload) // UNIT, len(payload) // UNIT, 0
    frames: list[bytes] = []
    for kbps, per in CARRIER.items():
        n, size = left // per, 3 * kbps
        if n:
            block = np.zeros((n, size), dtype=np.uint8)
            block[:, :_BODY] = np.frombuffer(_LEAD[kbps], np.uint8)
            block[:, _BODY : _BODY + per * UNIT] = np.frombuffer(payload, np.uint8, n * per * UNIT, at).reshape(n, -1)
            frames.append(block.tobytes())
            at += n * per * UNIT
            left -= n * per
    count = units // 4 + units % 4 // 2 + units % 2
    audio = b"".join(frames)
    ends = np.concatenate([np.full(units // 4, 960), np.full(units % 4 // 2, 480), np.full(units % 2, 240)]).cumsum()
    total = 240 + len(audio)
    toc = bytes(int(256 * (240 + (ends[k - 1] if (k := count * i // 100) else 0)) // total) for i in range(100))
    xing = (_carrier_header(80, protected=False) + bytes(17) + b"Xing" + (7).to_bytes(4, "big") + count.to_bytes(4, "big") + total.to_bytes(4, "big") + toc).ljust(240, b"\0")

    def safe(n: int) -> bytes:
        return bytes(n >> s & 127 for s in (21, 14, 7, 0))

    body = b""
    for name, text in ((b"TLEN", str(24 * count)), (b"TXXX", f"payload bytes\0{n_bytes}")):
        data = b"\3" + text.encode()
        body += name + safe(len(data)) + b"\0\0" + data
    return b"ID3\4\0\0" + safe(len(body)) + body + xing + audio + b"TAG" + b"carried bytes".ljust(125, b"\0")


def decode(media: bytes) -> tuple[bytes, int, Stream]:
    """(payload, unpadded size, parsed stream) of what `encode` made."""
    s = parse(media)
    payload = b"".join(media[at + _BODY : at + _BODY + CARRIER[h.kbps] * UNIT] for at, h in zip(s.offsets, s.headers, strict=True))
    return payload, int(s.tags["payload bytes"]), s


ENCODED = "doc_id bigint, media binary"
DECODED = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, samples bigint, sample_rate int, duration double, frame_offsets array<bigint>"


def _described(doc_id: int | None, media: bytes) -> tuple:
    payload, n, s = decode(media)
    if s.crc_bad or s.table.get("frames") != len(s.offsets):
        raise ValueError(f"document {doc_id}: the stored stream is damaged")
    feature = f"mpeg1.l3;{s.rate}Hz;frames={len(s.offsets)};samples={s.samples};ms={s.samples * 1000 // s.rate};crc_ok={s.crc_checked};first={s.offsets[0]};last={s.offsets[-1]};mid={s.offset_at(s.samples / s.rate / 2)}"
    return doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.samples, s.rate, s.samples / s.rate, s.offsets


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(padded(t), len(t)) for t in texts], pa.binary())], names=["doc_id", "media"])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("samples", pa.int64()), ("sample_rate", pa.int32()), ("duration", pa.float64()), ("frame_offsets", pa.list_(pa.int64()))])
    for batch in batches:
        rows = [_described(i, m.as_buffer().to_pybytes()) for i, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def _slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the stored stream of every text (null: empty); other columns are ignored, repeated rows give repeated streams."""
    return _slim(df, id_col, text_col).mapInArrow(_store, ENCODED)


def describe_media(media: DataFrame) -> DataFrame:
    """Read stored streams (doc_id, media) back: payload digests, exact duration in samples and seconds, checksum count and the
    byte offset of every frame, by which a player seeks. Damage raises."""
    return media.mapInArrow(_describe, DECODED)


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the streams of all texts as a media column of a table in the shared folder, and describe what is read back from it."""
    return describe_media(kept(store_media(df, id_col, text_col), "media", compression="zstd"))

"""Ogg media columns: write a payload as 8-bit samples in Ogg pages, and read such a column back.

The reader verifies the checksum of every page, reassembles packets from the
lacing values, demultiplexes the logical streams by serial number, and derives
timestamps from granule positions. The writer interleaves two logical streams:
unsigned 8-bit PCM samples, and an index with the number of bytes before padding.

Cases: a null or empty payload becomes 64 zero samples; payloads of any length
are kept whole, a page at a time; equal payloads give equal files, as serial
numbers come from the payload; empty tables give empty results; other columns
are ignored. ``demux`` raises OggError on a broken page; ``read_media`` gives
the reason in ``error`` and nulls elsewhere instead.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, steps

# Fixed values of the container format (RFC 3533).
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = 2**64 - 1

RATE = 8000
#: Samples in a packet; eight packets fill a page.
PACKET = 4096
PACKETS_PER_PAGE = 8
PAD = 64

_SAMPLES_HEAD = b"PCM     "
_INDEX_HEAD = b"QWINDEX\0"
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def checksum(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, start 0: zlib's on reversed bits."""
    reflected = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes


def write_page(page: Page) -> bytes:
    head = CAPTURE + struct.pack("<BBQIII", 0, page.flags, page.granule, page.serial, page.sequence, 0)
    data = head + bytes([len(page.lacing)]) + page.lacing + page.body
    return data[:22] + struct.pack("<I", checksum(data)) + data[26:]


def lace(length: int) -> bytes:
    return b"\xff" * (length // 255) + bytes([length % 255])


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[Page]:
    """Pages of one logical stream from (packet, granule position at its end); headers of stream start alone."""
    sequence, at, total = 0, 0, len(packets)
    while at < total:
        lacing, body, granule, n = b"", [], NO_GRANULE, 0
        while at < total and n < (1 if sequence == 0 else PACKETS_PER_PAGE):
            packet, ends = packets[at]
            values = lace(len(packet))
            if len(values) > 255 or len(lacing) + len(values) > 255:
                break
            lacing, granule, at, n = lacing + values, ends, at + 1, n + 1
            body.append(packet)
        if not n:  # a packet longer than a page goes over several
            packet, ends = packets[at]
            values, done, flag = lace(len(packet)), 0, 0
            while values:
                part, values = values[:255], values[255:]
                size = sum(part)
                last = not values
                yield Page(flag | (FIRST if sequence == 0 else 0) | (LAST if last and at + 1 == total else 0), ends if last else NO_GRANULE, serial, sequence, part, packet[done : done + size])
                done, sequence, flag = done + size, sequence + 1, CONTINUED
            at += 1
            continue
        yield Page((FIRST if sequence == 0 else 0) | (LAST if at == total else 0), granule, serial, sequence, lacing, b"".join(body))
        sequence += 1


def write(payload: bytes, n_bytes: int | None = None) -> bytes:
    """An Ogg file of a stream of samples and a stream that tells how many of them are not padding."""
    serial = zlib.crc32(payload)
    samples = [(_SAMPLES_HEAD + struct.pack(">HHIIBBHI", 0, 0, 0, RATE, 8, 1, PACKET, 0), 0)]
    for at in range(0, len(payload), PACKET):
        samples.append((payload[at : at + PACKET], min(at + PACKET, len(payload))))
    known = len(payload) if n_bytes is None else n_bytes
    index = [(_INDEX_HEAD, 0), (struct.pack("<QI", known, zlib.crc32(payload[:known])), len(payload))]
    a, b = pages_of(serial, samples), pages_of(serial ^ 1, index)
    out = [write_page(next(a)), write_page(next(b)), *map(write_page, b), *map(write_page, a)]
    return b"".join(out)


def parse_pages(data: bytes) -> Iterator[Page]:
    at = 0
    while at < len(data):
        if data[at : at + 4] != CAPTURE or at + 27 > len(data):
            raise OggError(f"no page at byte {at}")
        version, flags, granule, serial, sequence, crc = struct.unpack_from("<BBQIII", data, at + 4)
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            raise OggError(f"page at byte {at} is cut short or of another version")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of page at byte {at}")
        yield Page(flags, granule, serial, sequence, lacing, data[at + 27 + n : end])
        at = end


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position of each packet where a page ends with it, else -1.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False

    def seconds(self, rate: int) -> list[float]:
        """Time at the end of each packet whose granule position is known."""
        return [g / rate for g in self.granules if g >= 0]


def demux(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in order of their first pages."""
    streams: dict[int, Stream] = {}
    open_: dict[int, list[bytes]] = {}
    for page in parse_pages(data):
        if page.flags & FIRST:
            if page.serial in streams:
                raise OggError(f"stream {page.serial} begins twice")
            streams[page.serial], open_[page.serial] = Stream(page.serial), []
        if (s := streams.get(page.serial)) is None or s.ended:
            raise OggError(f"page of stream {page.serial} before its begin or after its end")
        if page.sequence != s.pages:
            raise OggError(f"stream {page.serial}: page {page.sequence} where {s.pages} is due")
        s.pages += 1
        held = open_[page.serial]
        if bool(page.flags & CONTINUED) != bool(held):
            raise OggError(f"stream {page.serial}: a packet breaks off")
        at, size, last_done = 0, 0, -1
        for value in page.lacing:
            size += value
            if value < 255:
                held.append(page.body[at : at + size])
                s.packets.append(b"".join(held))
                s.granules.append(-1)
                last_done = len(s.packets) - 1
                held.clear()
                at, size = at + size, 0
        if size or (page.lacing and page.lacing[-1] == 255):
            held.append(page.body[at : at + size])
        if last_done >= 0 and page.granule != NO_GRANULE:
            s.granules[last_done] = page.granule
        s.ended = bool(page.flags & LAST)
    for serial, held in open_.items():
        if held or not streams[serial].ended:
            raise OggError(f"stream {serial} doesn't end")
    return streams


def read(data: bytes) -> tuple[bytes, int, dict]:
    """Samples, how many are no padding, and what the container tells."""
    streams = demux(data)
    samples = next((s for s in streams.values() if s.packets[0].startswith(_SAMPLES_HEAD)), None)
    index = next((s for s in streams.values() if s.packets[0].startswith(_INDEX_HEAD)), None)
    if samples is None or index is None:
        raise OggError("no stream of samples or no index")
    rate = struct.unpack_from(">I", samples.packets[0], 16)[0]
    payload = b"".join(samples.packets[1:])
    known, crc = struct.unpack("<QI", index.packets[1])
    if known > len(payload) or zlib.crc32(payload[:known]) != crc or samples.granules[-1] != len(payload):
        raise OggError("samples don't agree with the index")
    times = samples.seconds(rate)
    return payload, known, {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": len(samples.packets) - 1, "rate": rate, "seconds": times[-1], "marks": len(times) - 1}


def pad(data: bytes) -> bytes:
    size = max(PAD, -(-len(data) // PAD) * PAD)
    return data + bytes(size - len(data))


def feature(payload: bytes, told: dict) -> str:
    """Times and loudness of samples as read: mean, zero crossings about it, and peak."""
    x = np.frombuffer(payload, np.uint8)
    mean = int(x.sum(dtype=np.int64)) / x.size
    above = x > mean
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    return f"seconds={told['seconds']:.6f};packets={told['packets']};pages={told['pages']};streams={told['streams']};marks={told['marks']};mean={mean:.4f};crossings={crossings};peak={int(x.max())}"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([write(pad(x), len(x)) for x in raw], pa.binary())], names=["doc_id", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "media"):
        rows = []
        for data in batch.column("media").to_pylist():
            try:
                payload, known, told = read(data or b"")
                rows.append((payload, known, told["seconds"], told["packets"], told["pages"], feature(payload, told), None))
            except (OggError, struct.error, IndexError) as e:
                rows.append((None, None, None, None, None, None, str(e) or type(e).__name__))
        kinds = [pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "payload", "n_bytes", "seconds", "packets", "pages", "feature", "error"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        out: list[list] = [[] for _ in range(8)]
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            media = write(pad(raw), len(raw))
            payload, known, told = read(media)
            values = (known, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, told), told["seconds"])
            for col, value in zip(out, values, strict=True):
                col.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", *names])


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text as an Ogg file."""
    return only(docs, id_col, text_col).mapInArrow(_write, f"doc_id {dict(docs.dtypes)[id_col]}, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """(doc_id, payload, n_bytes, seconds, packets, pages, feature, error) of a column ``media`` of Ogg files."""
    kind = dict(media.dtypes)["doc_id"]
    return media.select("doc_id", "media").mapInArrow(_read, f"doc_id {kind}, payload binary, n_bytes long, seconds double, packets long, pages long, feature string, error string")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As write_media and read_media of its bytes, with files and samples reduced to digests where they are made."""
    kind = dict(docs.dtypes)[id_col]
    return only(docs, id_col, text_col).mapInArrow(
        _digests, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double"
    )

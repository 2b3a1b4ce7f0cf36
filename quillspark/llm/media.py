"""Media columns in the Ogg container: pages with checksums, lacing values, logical streams and granule positions.

``with_media`` stores a text's payload as 8-bit samples: one logical stream of packets of 192 samples, whose granule
position counts samples, and beside it a stream with one packet of facts (the length before padding). ``decoded`` reads
the bytes back: it looks for the capture pattern, verifies every page's checksum, reassembles packets from the lacing
values, also across pages, parts the logical streams by serial number, and derives times from granule positions. Both
work document by document, without a shuffle.

Defined results: null is an empty text, whose payload is 192 blanks; equal texts give equal bytes; a very long text spans
as many pages as it needs; an empty table gives an empty result; other columns stay. Bytes that are not Ogg, damaged pages and lost pages give ``damaged`` > 0 (or a null media column a
null row), never an error."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quillspark.llm.tables import table

FRAME, RATE = 192, 8000
SAMPLES_SERIAL, FACTS_SERIAL = 0x51A7, 0x51A8
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, from 0. By zlib's, on reversed bits."""
    low_first = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low_first.to_bytes(4, "little").translate(_REVERSED), "big")


def page_bytes(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    whole = b"".join((head, lacing, body))
    return b"".join((whole[:22], checksum(whole).to_bytes(4, "little"), whole[26:]))


def stream_pages(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """The pages of a logical stream. The first packet, its header, has a page to itself; a packet may span pages."""
    pages: list[bytes] = []

    def close(segments: list[bytes], lacing: bytearray, flags: int, granule: int) -> None:
        pages.append(page_bytes(flags | (FIRST if not pages else 0), granule, serial, len(pages), bytes(lacing), b"".join(segments)))

    for own, grain in ((packets[:1], granules[:1]), (packets[1:], granules[1:])):
        segments, lacing, flags, granule = [], bytearray(), 0, -1
        for packet, ends in zip(own, grain, strict=True):
            values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
            at = 0
            while values:
                room = 255 - len(lacing)
                if not room:
                    close(segments, lacing, flags, granule)
                    segments, lacing, granule = [], bytearray(), -1
                    flags, room = CONTINUED if at or len(values) < len(packet) // 255 + 1 else 0, 255
                part, values = values[:room], values[room:]
                size = sum(part) if len(part) > 1 else part[0]
                segments.append(packet[at : at + size])
                lacing += part
                at += size
            granule = ends
        if lacing:
            close(segments, lacing, flags, granule)
    last = pages[-1]
    head = _HEAD.unpack_from(last)
    lacing = last[27 : 27 + head[7]]
    pages[-1] = page_bytes(head[2] | LAST, head[3], serial, head[5], lacing, last[27 + head[7] :])
    return pages


def encode(payload: bytes, facts: bytes) -> bytes:
    """A physical stream: the first pages of both logical streams, then the facts, then the samples."""
    header = b"\x01samples8" + struct.pack("<II", RATE, FRAME)
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    samples = stream_pages([header, *frames], [0, *range(FRAME, len(payload) + FRAME, FRAME)][: len(frames) + 1], SAMPLES_SERIAL)
    noted = stream_pages([b"\x01facts", facts], [0, 0], FACTS_SERIAL)
    return b"".join((samples[0], *noted, *samples[1:]))


@dataclass
class Stream:
    """A logical stream: its packets, and the granule position after each packet (-1: not given)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    damaged: int = 0
    ended: bool = False
    next_page: int = 0
    open: list[bytes] | None = None


def decode(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and how many pages were damaged or lost."""
    streams: dict[int, Stream] = {}
    at, damaged = 0, 0
    while True:
        found = data.find(b"OggS", at)
        if found != at:
            damaged += 1 if found >= 0 or at < len(data) else 0
            if found < 0:
                break
            at = found
        if at + 27 > len(data):
            damaged += at < len(data)
            break
        _, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        size = 27 + count + sum(lacing)
        whole = data[at : at + size]
        if version or len(whole) < size or checksum(b"".join((whole[:22], b"\0\0\0\0", whole[26:]))) != crc:
            damaged += 1
            at += 4  # the next capture pattern may lie inside
            continue
        at += size
        s = streams.setdefault(serial, Stream())
        if number != s.next_page:
            s.damaged += 1
            s.open = None
        s.next_page, s.ended = number + 1, bool(flags & LAST)
        parts, skip = s.open if flags & CONTINUED and s.open is not None else [], bool(flags & CONTINUED and s.open is None)
        place, length = 27 + count, 0
        begun = len(s.packets)
        for value in lacing:
            length += value
            if value == 255:
                continue
            if skip:
                skip = False
            else:
                s.packets.append(b"".join((*parts, whole[place : place + length])) if parts else whole[place : place + length])
                s.granules.append(-1)
            parts, place, length = [], place + length, 0
        if len(s.packets) > begun:
            s.granules[-1] = granule
        s.open = [*parts, whole[place : place + length]] if lacing and lacing[-1] == 255 and not skip else None
    return streams, damaged + sum(s.damaged + (s.open is not None) + (not s.ended) for s in streams.values())


def payload_of(text: str | bytes) -> tuple[bytes, int]:
    """A text's padded bytes, and their number before padding."""
    raw = text.encode("utf-8") if isinstance(text, str) else text
    return raw + b" " * (-len(raw) % FRAME or (0 if raw else FRAME)), len(raw)


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a binary column ``media`` for the text; other columns stay as they are."""
    docs = docs.drop("media")
    schema = StructType([*docs.schema, StructField("media", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            made = []
            for t in texts:
                payload, n = payload_of(t or b"")
                made.append(encode(payload, n.to_bytes(8, "little")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "media"])

    return docs.mapInArrow(run, schema)


def feature(samples: np.ndarray, granule: int) -> str:
    """Seconds, mean, loudness, crossings of the mean line a second, and the loudest frame's time."""
    if not len(samples):
        return "0.000000|0.000|0.000|0.000|0.000000"
    x = samples.astype(np.int64)
    seconds = granule / RATE
    centred = x * len(x) - x.sum()
    crossings = int(np.count_nonzero((centred[1:] >= 0) != (centred[:-1] >= 0)))
    power = np.add.reduceat((x - 128) ** 2, np.arange(0, len(x), FRAME))
    return f"{seconds:.6f}|{x.sum() / len(x):.3f}|{(int(((x - 128) ** 2).sum()) / len(x)) ** 0.5:.3f}|{crossings / seconds if seconds else 0.0:.3f}|{int(power.argmax()) * FRAME / RATE:.6f}"


DECODED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, damaged long, seconds double"


def decoded(stored: DataFrame) -> DataFrame:
    """A row for each (doc_id, media): what the container holds."""

    def one(doc_id: int | None, data: bytes | None) -> tuple:
        if data is None:
            return (doc_id, *[None] * 9)
        streams, damaged = decode(data)
        samples, facts = streams.get(SAMPLES_SERIAL, Stream()), streams.get(FACTS_SERIAL, Stream())
        payload = b"".join(samples.packets[1:])
        n = int.from_bytes(facts.packets[1], "little") if len(facts.packets) > 1 else None
        granule = max([0, *samples.granules[-1:]])
        return (
            doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data),
            hashlib.sha256(data).hexdigest(), feature(np.frombuffer(payload, np.uint8), granule), damaged + (n is None), granule / RATE,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64())
        names = [x.split()[0] for x in DECODED.split(", ")]
        for batch in batches:
            if rows := [one(i, m) for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return stored.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, DECODED)


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(with_media(table(spark, sf_dir, "documents").select("doc_id", "text")))

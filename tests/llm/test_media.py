import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import media


def _slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
        crc &= 0xFFFFFFFF
    return crc


def test_checksum():
    assert all(media.checksum(x) == _slow_crc(x) for x in (b"", b"a", b"OggS" * 50, bytes(range(256))))


def test_round_trip(docs_of):
    rows = [(1, None), (2, ""), (3, "x" * 192), (4, "é𝄞 " * 100), (5, "long " * 40000), (6, "x" * 192)]
    got = {r.doc_id: r for r in media.decoded(media.with_media(docs_of(rows))).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.damaged == 0 and r.seconds == len(payload) / 8000 and r.media_bytes > len(payload)
    assert got[3][3:] == got[6][3:] and got[1][3:] == got[2][3:]


@pytest.mark.parametrize("sizes", [[5, 0, 254, 255, 256, 510], [70000, 1, 65025, 65024, 3], [255 * 255, 255 * 254, 10**6]])
def test_packets_across_pages(sizes):
    rnd = random.Random(4)
    packets = [b"head"] + [rnd.randbytes(n) for n in sizes]
    granules = list(range(len(packets)))
    pages = media.stream_pages(packets, granules, 7)
    other = media.stream_pages([b"h2", b"zz"], [0, 9], 8)
    streams, damaged = media.decode(b"".join([pages[0], other[0], other[1], *pages[1:]]))
    assert damaged == 0 and streams[7].packets == packets and streams[8].packets == [b"h2", b"zz"] and streams[8].granules[-1] == 9


def test_damage_is_found(spark, docs_of):
    stored = media.with_media(docs_of([(1, "hello " * 30000)])).first().media
    broken = bytearray(stored)
    broken[70000] ^= 1
    streams, damaged = media.decode(bytes(broken))
    assert damaged and b"".join(streams[media.SAMPLES_SERIAL].packets[1:]) != media.payload_of("hello " * 30000)[0]
    assert media.decode(stored[:-3])[1] and media.decode(b"nonsense")[1] and media.decode(b"") == ({}, 0)
    odd = spark.createDataFrame([(1, None), (2, b"junk"), (None, stored)], "doc_id long, media binary")
    rows = {r.doc_id: r for r in media.decoded(odd).collect()}
    assert rows[1].damaged is None and rows[2].damaged > 0 and rows[None].damaged == 0
    assert media.with_media(docs_of([(1, "x")]).withColumn("media", F.lit(0))).schema["media"].dataType.typeName() == "binary"
    assert media.decoded(media.with_media(docs_of([(1, "x")]).limit(0))).count() == 0

import hashlib
import struct
import zlib

import pytest

from packloom.llm import ogg, warc

ROWS = [(1, "http://a", "same", "x"), (2, "http://b", "same", "x"), (3, None, None, None), (4, "u\r\nX: y", "", "y"), (5, "http://c", "é" * 70000, "z"), (5, "http://c", "é" * 70000, "z")]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, key string")
    got = {(r.key, r.record_type): r for r in warc.round_trip(df, "page_id", "url", "html").collect()}
    assert got[1, "response"].payload == "same" and got[2, "revisit"].refers_to == 1
    assert got[3, "response"].payload_bytes == 0 and got[4, "revisit"].refers_to == 3
    assert got[5, "response"].payload_digest == warc.sha1_base32(("é" * 70000).encode())
    assert warc.round_trip(df.limit(0), "page_id", "url", "html").count() == 0


def test_warc_reader_finds_damage():
    a = warc.build_record("response", "<urn:x:1>", "http://a", b"body" * 100)
    both = a + warc.build_record("revisit", "<urn:x:2>", "http://b", b"body" * 100, "<urn:x:1>")
    for step in (1, 7, 1000):
        rs = list(warc.read_records(both[i : i + step] for i in range(0, len(both), step)))
        assert [r.kind for r in rs] == ["response", "revisit"] and rs[0].http()[1] == b"body" * 100
    raw = zlib.decompress(a, 31)
    for bad in (a[:-9], zlib.compress(raw.replace(b"bodybody", b"bodyBody", 1), wbits=31), zlib.compress(raw.replace(b"\r\nContent-Length: 4", b"\r\nContent-Length: 5"), wbits=31)):
        with pytest.raises(warc.WarcError):
            list(warc.read_records([bad]))


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 1 << 31 else c << 1) & 0xFFFFFFFF
    return c


def test_ogg_crc_and_packets():
    for d in (b"", b"a", bytes(range(256)) * 3):
        assert ogg.page_crc(d) == slow_crc(d)
    packets = [b"head", b"", b"x" * 255, b"y" * 200_000, b"z"]
    got = ogg.demux(b"".join(ogg.paginate(packets, [0, 1, 2, 3, 4], 7)))[7]
    assert got.packets == packets and got.granules[-1] == 4


def test_ogg_finds_damage():
    payload, _ = ogg.payload_of("abc" * 50_000)
    media = ogg.mux(payload, b"n")
    assert ogg.read_samples(media)[0] == payload and len(ogg.demux(media)) == 2
    starts = [i for i in range(len(media)) if media[i : i + 4] == b"OggS"]
    bad = bytearray(media)
    bad[starts[3] + 300] ^= 1
    for x in (bytes(bad), media[:-5], media[: starts[2]] + media[starts[4] :]):
        with pytest.raises(ogg.OggError):
            ogg.demux(x)
    _, s, _ = ogg.read_samples(media)
    assert s.times()[2:] == [576 * (i + 1) for i in range(len(payload) // 576)]


def test_ogg_rows(spark):
    texts = [None, "", "a" * 576, "é" * 289, "word " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ogg.media_features(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[0].asDict() | {"doc_id": 1} == got[1].asDict()
    assert ogg.media_features(df.limit(0)).count() == 0
    media = {r.doc_id: bytes(r.media) for r in ogg.encode_texts(df).collect()}
    assert hashlib.sha256(media[4]).hexdigest() == got[4].media_sha256 and struct.unpack_from("<I", media[4], 14)

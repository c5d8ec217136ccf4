"""Ogg containers: page checksums, lacing, logical streams and granule times.

A payload is stored as unsigned 8-bit PCM in one logical stream, packets of 576
samples, and multiplexed with a second logical stream that carries a comment
packet. Reading verifies every page checksum, groups pages by serial number,
checks page order, joins lacing values to packets (also over page ends) and
derives each packet's time from the granule positions.

Defined results: a null text is the empty text, whose payload is one block of
bytes 255; repeated rows give equal values; extra columns are ignored.
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

from packloom.runtime import prepare

BLOCK = 576
RATE = 8000
_REV = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_CONT, _BOS, _EOS = 1, 2, 4
_FIXED = struct.Struct("<4sBBqIIIB")


class OggError(ValueError):
    """A stream that breaks the container's rules."""


def page_crc(page: bytes) -> int:
    """CRC with polynomial 0x04C11DB7, not reflected, initial value 0.

    zlib's CRC is the reflected form of the same polynomial: with the bits of
    each byte reversed and the initial and final inversions undone it gives the
    wanted value with its bits reversed.
    """
    v = zlib.crc32(page.translate(_REV), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(v.to_bytes(4, "little").translate(_REV), "big")


def make_page(flags: int, granule: int, serial: int, seq: int, lacing: bytes, body: bytes) -> bytes:
    head = _FIXED.pack(b"OggS", 0, flags, granule, serial, seq, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return b"".join((head[:22], struct.pack("<I", crc), head[26:], body))


def paginate(packets: list[bytes], granules: list[int], serial: int, fill: int = 255) -> list[bytes]:
    """Pages of one logical stream, for packets of any length; the first packet
    has a page of its own. A page's granule is that of the last packet that ends
    on it, or -1 if none does."""
    pages, seq = [], 0
    lacing, body, granule, cont = bytearray(), [], -1, 0

    def flush(extra=0):
        nonlocal lacing, body, granule, cont, seq
        pages.append(make_page(extra | cont, granule, serial, seq, bytes(lacing), b"".join(body)))
        lacing, body, granule, cont, seq = bytearray(), [], -1, 0, seq + 1

    for i, (packet, g) in enumerate(zip(packets, granules)):
        at, last = 0, i == len(packets) - 1
        segs = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while done < len(segs):
            if len(lacing) == fill:
                flush(_BOS if seq == 0 else 0)
                cont = _CONT if done else 0
            take = segs[done : done + fill - len(lacing)]
            n = sum(take)
            lacing += take
            body.append(packet[at : at + n])
            at, done = at + n, done + len(take)
        granule = g
        if i == 0 and not last:
            flush(_BOS)
    flush((_BOS if seq == 0 else 0) | _EOS)
    return pages


def pcm_header(rate: int = RATE) -> bytes:
    """Main header: unsigned 8-bit samples (format 1), one channel."""
    return b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, rate, 8, 1, BLOCK, 1)


def mux(payload: bytes, comment: bytes = b"", rate: int = RATE) -> bytes:
    """An Ogg file with the payload's samples and a comment stream. Serial
    numbers come from the payload, so equal payloads give equal files."""
    serial = zlib.crc32(payload)
    n = len(payload) // BLOCK
    if n * BLOCK != len(payload) or not n:
        raise OggError(f"the payload must be a positive multiple of {BLOCK}")
    packets = [pcm_header(rate), comment] + [payload[i * BLOCK : (i + 1) * BLOCK] for i in range(n)]
    audio = paginate(packets, [0, 0] + [BLOCK * (i + 1) for i in range(n)], serial)
    notes = paginate([b"notes\0\0\0", comment], [0, n * BLOCK], serial ^ 0x5A5A5A5A)
    # Both first pages come first; then the pages of the streams alternate.
    out, rest = [audio[0], notes[0]], [audio[1:], notes[1:]]
    for i in range(max(map(len, rest))):
        out += [r[i] for r in rest if i < len(r)]
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: End time in samples of each packet, -1 where the page gives none.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    eos: bool = False
    _open: list[bytes] = field(default_factory=list)

    def times(self, block: int = BLOCK) -> list[int]:
        """End position of each packet in samples. Only the last packet that
        ends on a page has a granule; those before it count back by ``block``."""
        out, after = list(self.granules), None
        for i in range(len(out) - 1, -1, -1):
            if out[i] < 0 and after is not None:
                out[i] = max(0, after - block)
            after = out[i]
        return out


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, seq, lacing, body) of each page, checksums verified."""
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError("the last page is cut off")
        magic, version, flags, granule, serial, seq, crc, nseg = _FIXED.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + nseg]
        start = at + 27 + nseg
        end = start + sum(lacing)
        if len(lacing) < nseg or end > len(data):
            raise OggError("the last page is cut off")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum of page {seq} of stream {serial:#x}")
        yield flags, granule, serial, seq, lacing, data[start:end]
        at = end


def demux(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number, with whole packets."""
    streams: dict[int, Stream] = {}
    for flags, granule, serial, seq, lacing, body in pages(data):
        s = streams.get(serial)
        if s is None:
            if not flags & _BOS:
                raise OggError("a stream has no first page")
            s = streams[serial] = Stream(serial)
        if seq != s.pages:
            raise OggError(f"page {s.pages} of stream {serial:#x} is missing")
        if bool(flags & _CONT) != bool(s._open):
            raise OggError("a continued packet has no start or no end")
        s.pages += 1
        at = start = 0
        first = len(s.packets)
        for v in lacing:
            at += v
            if v < 255:
                piece = body[start:at]
                s.packets.append(b"".join([*s._open, piece]) if s._open else piece)
                s.granules.append(-1)
                s._open, start = [], at
        if start < at:
            s._open.append(body[start:at])
        if len(s.packets) > first:
            s.granules[-1] = granule
        s.eos = bool(flags & _EOS)
    for s in streams.values():
        if s._open or not s.eos:
            raise OggError("a stream does not end")
    return streams


def read_samples(data: bytes) -> tuple[bytes, Stream, int]:
    """Samples, their stream and the sample rate of the PCM stream in a file."""
    for s in demux(data).values():
        if s.packets[0][:8] == b"PCM     ":
            _, _, fmt, rate, bits, channels, _, extra = struct.unpack(">HHIIBBHI", s.packets[0][8:28])
            if (fmt, bits, channels) != (1, 8, 1):
                raise OggError("not unsigned 8-bit mono samples")
            return b"".join(s.packets[1 + extra :]), s, rate
    raise OggError("no PCM stream")


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def features(samples: bytes, stream: Stream, rate: int) -> str:
    """Packets, pages, duration, and mean, RMS, peak and zero crossings of the
    samples around 128."""
    x = np.frombuffer(samples, np.uint8)
    n = len(x)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256) - 128
    mean = float(counts @ level) / n
    rms = float(np.sqrt(counts @ (level * level) / n))
    peak = int(np.abs(level[counts > 0]).max())
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    end = stream.times()[-1]
    return f"packets={len(stream.packets)};pages={stream.pages};seconds={end / rate:.6f};mean={mean:.4f};rms={rms:.4f};peak={peak};crossings={crossings}"


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """DataFrame[key, media binary]: the whole text of each row as an Ogg file."""
    return _map(df, key, text, lambda t: (mux(*_commented(t)),), "media binary", [pa.binary()])


def _commented(text):
    payload, n = payload_of(text)
    return payload, b"bytes=%d" % n


def media_features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each whole text as an Ogg file, read it back and describe it.

    DataFrame[key, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature]. The file lives only inside the task.
    """

    def one(t):
        payload, note = _commented(t)
        media = mux(payload, note)
        samples, stream, rate = read_samples(media)
        unpadded = int(stream.packets[1].partition(b"=")[2])
        return unpadded, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(samples, stream, rate)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _map(df, key, text, one, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", types)


def _map(df: DataFrame, key: str, text: str, one, schema: str, types: list) -> DataFrame:
    names = [key] + [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [one(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows), types))], names=names)

    prepare(df.sparkSession)
    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {schema}")

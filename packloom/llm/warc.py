"""WARC archives: a writer, and a sequential reader.

Every record is one gzip member. The reader takes the bytes of an archive in
chunks, inflates one member after another with an incremental zlib object,
frames each record by its Content-Length and verifies its digests.

Defined results: a null payload counts as the empty payload; a null url is
written as ``about:blank``; repeated rows each get a record; an empty table
gives no archives and no rows; extra input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.runtime import materialise, prepare

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 4 << 20
CHUNK = 64 << 10


class WarcError(ValueError):
    """An archive that breaks framing or a digest."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    def http(self) -> tuple[dict[str, str], bytes]:
        """HTTP headers and body of the block."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        fields = {}
        for line in head.split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode("latin-1")] = v.strip().decode("latin-1")
        return fields, body


def build_record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> bytes:
    """One gzip member. A revisit keeps the HTTP head, whose Content-Length and
    payload digest are those of the full payload, and leaves the body out."""
    digest = sha1_base32(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if kind == "revisit" else head + payload
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    raw = VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def _members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated bytes of each gzip member, one member at a time."""
    inflater, parts = None, []
    for chunk in chunks:
        while chunk:
            if inflater is None:
                inflater, parts = zlib.decompressobj(31), []
            try:
                parts.append(inflater.decompress(chunk))
            except zlib.error as e:
                raise WarcError(f"broken gzip member: {e}") from e
            chunk = b""
            if inflater.eof:
                chunk = inflater.unused_data
                inflater = None
                yield b"".join(parts)
    if inflater is not None:
        raise WarcError("the last gzip member is cut off")


def _frame(raw: bytes) -> Record:
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/"):
        raise WarcError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        k, _, v = line.partition(b":")
        headers[k.strip().lower().decode("ascii")] = v.strip().decode("utf-8")
    try:
        n = int(headers["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    if len(rest) < n + 4 or rest[n : n + 4] != b"\r\n\r\n":
        raise WarcError("the block is not as long as Content-Length says")
    if len(rest) != n + 4:
        raise WarcError("more than one record in a gzip member")
    return Record(headers, rest[:n])


def _verify(r: Record) -> None:
    want = r.headers.get("warc-block-digest")
    if want and want != f"sha1:{sha1_base32(r.block)}":
        raise WarcError("block digest differs")
    want = r.headers.get("warc-payload-digest")
    if want and r.kind == "response":
        fields, body = r.http()
        if want != f"sha1:{sha1_base32(body)}" or int(fields.get("content-length", len(body))) != len(body):
            raise WarcError("payload digest or length differs")


def read_records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """The verified records of an archive, in order."""
    for raw in _members(chunks):
        r = _frame(raw)
        _verify(r)
        yield r


def mark_revisits(df: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: the smallest key with an equal payload of at least
    ``min_bytes`` bytes, null for the record that has that key itself.

    Payloads are equal if SHA-1 and length are. Digests are aggregated before the
    shuffle, so a payload that a third of all rows share arrives as one row per
    task. Keys and digests alone are joined by digest; the payloads, which are long,
    are dealt by key and digest and meet only what their own row refers to.
    """
    digest = F.concat_ws(":", F.sha1(F.col(payload)), F.octet_length(F.col(payload)))
    own = df.withColumn("__d", digest)
    ids = own.where(F.octet_length(payload) >= min_bytes).select(F.col(key).alias("__k"), F.col("__d").alias("__e"))
    first = ids.groupBy("__e").agg(F.min("__k").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    # Rows with the same key and payload are one here, and refer to the same.
    revisits = ids.join(first, "__e").where(~F.col("__k").eqNullSafe(F.col("__first"))).groupBy("__k", "__e").agg(F.first("__first").alias("refers_to"))
    out = own.join(revisits, own[key].eqNullSafe(revisits["__k"]) & (own["__d"] == revisits["__e"]), "left")
    return out.drop("__d", "__k", "__e")


def write_archives(df: DataFrame, prefix: str = "page", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows (key long, uri string, payload string, refers_to long) to archives.

    Returns DataFrame[archive string, warc binary]; each task closes an archive
    when it reaches ``archive_bytes``, so a task holds one archive at a time.
    """

    def run(batches):
        import uuid

        def close(parts):
            return pa.RecordBatch.from_pydict({"archive": pa.array([uuid.uuid4().hex]), "warc": pa.array([b"".join(parts)], pa.binary())})

        parts, size = [], 0
        for b in batches:
            for key, uri, payload, ref in zip(*(b.column(c).to_pylist() for c in ("key", "uri", "payload", "refers_to"))):
                rid = lambda k: f"<urn:{prefix}:{k}>"
                parts.append(build_record("response" if ref is None else "revisit", rid(key), uri or "about:blank", (payload or "").encode("utf-8"), None if ref is None else rid(ref)))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield close(parts)
                    parts, size = [], 0
        if parts:
            yield close(parts)

    prepare(df.sparkSession)
    uri = F.regexp_replace("uri", r"[\r\n]+", " ")
    return df.select("key", uri.alias("uri"), "payload", F.col("refers_to").cast("long").alias("refers_to")).mapInArrow(run, "archive string, warc binary")


def read_archives(df: DataFrame) -> DataFrame:
    """Archives back to records: one row per record, read sequentially."""

    def key(rid):
        v = rid.strip("<>").rpartition(":")[2] if rid else "None"
        return None if v == "None" else int(v)

    def run(batches):
        for b in batches:
            for warc in b.column("warc"):
                view = memoryview(warc.as_buffer())
                rows = []
                for r in read_records(bytes(view[i : i + CHUNK]) for i in range(0, len(view), CHUNK)):
                    fields, body = r.http()
                    rows.append((key(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), int(fields["content-length"]), r.headers["warc-payload-digest"].partition(":")[2], r.kind, key(r.headers["warc-refers-to"]) if r.kind == "revisit" else None, body.decode("utf-8") if r.kind == "response" else None))
                cols = list(zip(*rows)) or [[]] * 7
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["key", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    prepare(df.sparkSession)
    return df.select("warc").mapInArrow(run, "key long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def round_trip(df: DataFrame, key: str, uri: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """Write every row to archives in the shared folder, then read them back."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(uri).alias("uri"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    stored = materialise(write_archives(mark_revisits(rows, "key", "payload", min_bytes)), "warc")
    return read_archives(stored)

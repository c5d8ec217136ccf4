"""ZIP archives as a Spark data source, to read and to write.

``read_archives`` gives one row a member. An archive larger than a partition is cut by its
central directory: the driver reads that alone, and each task gets a run of members with
their places and reads those bytes and no others. Smaller archives are dealt out whole,
several to a task, and are not opened before. Globs on names of members and packages are
options of the source: other members are neither read nor inflated. They are no pushed
filters, as Spark 4.1.2 keeps what one query pushed to a Python source for the next query
on the same DataFrame, which then lacks rows.

``write_archives`` streams the members of a package into one archive. A task writes below
a folder of the job that no reader sees; the commit moves the archives to their places
once all tasks have ended, an abort takes the folder away. Stored and deflated members are
read; sizes and checksums are verified.

Paths are those of ``pyarrow.fs``: local ones, ``file:``, ``s3:``, ``gs:``, ``hdfs:``.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from packloom.runtime import prepare

NAME = "packloom_archive"
#: Compressed bytes of a partition, and bytes and rows that a task hands over at once.
PARTITION_BYTES = 32 << 20
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000
SUFFIXES = (".zip", ".imscc")
FIXED_TIME = (1980, 1, 1, 0, 0, 0)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlsplit(path).path
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _archives(path: str, suffixes: tuple[str, ...] = SUFFIXES) -> list[tuple[str, int]]:
    """Names and sizes of a file, or of those of a kind in a folder at any depth."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(part[:1] in "._" for part in p[len(at) :].strip("/").split("/"))
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.lower().endswith(suffixes) and not hidden(i.path))


def package_of(archive: str) -> str:
    return posixpath.splitext(posixpath.basename(archive))[0]


@dataclass(frozen=True)
class Member:
    """A member by the central directory; ``at`` is the place of its local header."""

    path: str
    at: int
    method: int
    stored: int
    size: int
    crc: int


def directory(f, name: str) -> list[Member]:
    """Members of an archive, in the order of its directory; folders are left out."""
    try:
        z = zipfile.ZipFile(f)
    except zipfile.BadZipFile as e:
        raise ValueError(f"{name} is no archive: {e}") from e
    for i in z.infolist():
        if i.flag_bits & 1 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"{i.filename} in {name}: encrypted, or a method that is not read")
    return [Member(i.filename, i.header_offset, i.compress_type, i.compress_size, i.file_size, i.CRC) for i in z.infolist() if not i.is_dir()]


def content(f, m: Member, name: str) -> bytes:
    """A member's bytes, from its own part of the file."""
    f.seek(m.at)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {m.at} of {name}")
    f.seek(m.at + 30 + sum(struct.unpack("<HH", head[26:30])))
    data = f.read(m.stored)
    try:
        out = zlib.decompress(data, -15) if m.method == zipfile.ZIP_DEFLATED else data
    except zlib.error as e:
        raise ValueError(f"{m.path} in {name}: {e}") from e
    if len(out) != m.size or zlib.crc32(out) != m.crc:
        raise ValueError(f"{m.path} in {name}: size or checksum differs")
    return out


@dataclass(frozen=True)
class Wanted:
    """Globs on names: of members, without folders where the glob has none, and of
    packages. An empty one takes all."""

    members: str = ""
    packages: str = ""

    def package(self, name: str) -> bool:
        return not self.packages or fnmatch.fnmatchcase(name, self.packages)

    def path(self, name: str) -> bool:
        return not self.members or fnmatch.fnmatchcase(name if "/" in self.members else posixpath.basename(name), self.members)


class Part(InputPartition):
    """Whole archives (no members named), or some members of one."""

    def __init__(self, archives: list[str], members: list[Member] | None = None):
        self.archives, self.members = archives, members


class Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.listing = options.get("listing", "false").lower() == "true"
        self.wanted = Wanted(options.get("members", ""), options.get("packages", ""))

    def partitions(self) -> list[Part]:
        store, _ = _store(self.root)
        parts, small, held = [], [], 0
        for name, size in _archives(self.root):
            if not self.wanted.package(package_of(name)):
                continue
            if size > self.most and not self.listing:
                with store.open_input_file(name) as f:
                    members = sorted((m for m in directory(f, name) if self.wanted.path(m.path)), key=lambda m: m.at)
                run, weight = [], 0
                for m in members:
                    if run and weight + m.stored > self.most:
                        parts.append(Part([name], run))
                        run, weight = [], 0
                    run.append(m)
                    weight += m.stored
                parts += [Part([name], run)] if run else []
                continue
            if small and held + size > self.most:
                parts.append(Part(small))
                small, held = [], 0
            small.append(name)
            held += size
        return parts + ([Part(small)] if small else []) or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.root)
        rows: list[tuple] = []
        weight = 0

        def batch():
            kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["package", "path", "size", "content"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names[: len(rows[0])])

        for name in part.archives:
            with store.open_input_file(name) as f:
                members = part.members if part.members is not None else [m for m in directory(f, name) if self.wanted.path(m.path)]
                for m in members:
                    row = (package_of(name), m.path, m.size)
                    rows.append(row if self.listing else (*row, content(f, m, name)))
                    weight += 0 if self.listing else m.size
                    if weight >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch()
                        rows, weight = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    suffixes = SUFFIXES

    def __init__(self, options, overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        _, self.at = _store(self.root)
        self.folder = f"{self.at}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        """Archives of the packages of a task, whose rows stand together."""
        store, _ = _store(self.root)
        folder = f"{self.folder}/{uuid.uuid4().hex}"
        store.create_dir(folder)
        moves: list[tuple[str, str]] = []
        seen: set[str] = set()
        now, out, z = None, None, None
        try:
            for b in iterator:
                columns = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("package", "path", "content"))
                for package, path, data in zip(*columns):
                    if not package or "/" in package or not path:
                        raise ValueError(f"no name for an archive or a member: {package!r}, {path!r}")
                    if package != now:
                        if package in seen:
                            raise ValueError(f"the rows of {package} do not stand together")
                        if z is not None:
                            z.close(), out.close()
                        seen.add(package)
                        now, temp = package, f"{folder}/{len(moves)}.zip"
                        out = store.open_output_stream(temp)
                        z = zipfile.ZipFile(_Unseekable(out), "w", zipfile.ZIP_DEFLATED)
                        moves.append((temp, f"{self.at}/{package}.zip"))
                    z.writestr(zipfile.ZipInfo(path, FIXED_TIME), data or b"", zipfile.ZIP_DEFLATED)
        finally:
            if z is not None:
                z.close(), out.close()
        return Written(moves)

    def commit(self, messages) -> None:
        store, _ = _store(self.root)
        moves = [m for message in messages if message for m in message.moves]
        to = [t for _, t in moves]
        if len(set(to)) < len(to):
            self.abort(messages)
            raise ValueError("a package was written by more than one task")
        there = [name for name, _ in _archives(self.root, self.suffixes)] if store.get_file_info(self.at).type == fs.FileType.Directory else []
        if not self.overwrite and set(there) & set(to):
            self.abort(messages)
            raise ValueError(f"{sorted(set(there) & set(to))[0]} is there already")
        for source, target in moves:
            store.move(source, target)
        for name in set(there) - set(to) if self.overwrite else ():
            store.delete_file(name)
        self.abort(messages)

    def abort(self, messages) -> None:
        """Takes away what is not in its place."""
        store, _ = _store(self.root)
        if store.get_file_info(self.folder).type == fs.FileType.Directory:
            store.delete_dir(self.folder)


class _Unseekable:
    """A stream that ZIP members are written to one after another."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


class Archives(DataSource):
    """Options: path; members and packages, globs on names; partitionBytes; listing (true
    for names and sizes alone)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        names = "package string, path string, size long"
        return names if self.options.get("listing", "false").lower() == "true" else f"{names}, content binary"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def read_archives(spark: SparkSession, path: str, members: str = "", packages: str = "", partition_bytes: int = PARTITION_BYTES, listing: bool = False) -> DataFrame:
    """DataFrame[package, path, size, content] of an archive or a folder of archives;
    without ``content`` where only a listing is wanted. ``members`` and ``packages`` are globs
on names: what they leave out is neither read nor inflated. A file that is no archive, and a
    member that can't be read, are errors."""
    prepare(spark)
    spark.dataSource.register(Archives)
    options = {"members": members, "packages": packages, "partitionBytes": str(partition_bytes), "listing": str(listing).lower()}
    return spark.read.format(NAME).options(**options).load(path)


def write_archives(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    """Rows (package, path, content) as one archive a package in the folder ``path``,
    members by path. Packages go to tasks by hash and are streamed, so an archive may be
    larger than a task's memory. Null content is empty; a null or empty name is an error."""
    prepare(rows.sparkSession)
    rows.sparkSession.dataSource.register(Archives)
    dealt = rows.select(F.col("package").cast("string").alias("package"), F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).repartition("package").sortWithinPartitions("package", "path")
    dealt.write.format(NAME).mode("overwrite" if overwrite else "append").save(path)

"""Files: packages (ZIP), documents (DOCX), spreadsheets (XLSX, CSV), snapshots.

Archives are read by Spark's ``binaryFile`` reader, so any store that Spark can
reach works and files are spread over the tasks; their members are unpacked in an
Arrow stage, one archive at a time.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.runtime import prepare


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    prepare(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def members(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """DataFrame[package, path, content binary]: the members of ZIP archives; the
    package is the archive's name. A broken archive gives no rows."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    z = zipfile.ZipFile(io.BytesIO(data.as_py()))
                except zipfile.BadZipFile:
                    continue
                package = posixpath.splitext(posixpath.basename(name))[0]
                for info in z.infolist():
                    if not info.is_dir():
                        yield pa.RecordBatch.from_pydict({"package": [package], "path": [info.filename], "content": pa.array([z.read(info)], pa.binary())})

    prepare(files.sparkSession)
    return files.select(path, content).mapInArrow(run, "package string, path string, content binary")


def read_packages(spark: SparkSession, path: str, pattern: str = "*.{zip,imscc}") -> DataFrame:
    return members(_files(spark, path, pattern))


def decode_text(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are not UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def html_documents(packages: DataFrame) -> DataFrame:
    """DataFrame[package, path, html] of the HTML members."""
    rows = packages.where(F.col("path").rlike(r"(?i)\.html?$"))
    return rows.select("package", "path", decode_text(F.col("content")).alias("html"))


def write_packages(rows: DataFrame, order: str = "path") -> DataFrame:
    """DataFrame[package, content]: (package, path, content) rows as ZIP archives,
    members sorted by path. A package is one archive, so one task holds it."""

    def run(batches):
        now, buf, z = None, None, None

        def close():
            z.close()
            return pa.RecordBatch.from_pydict({"package": [now], "content": pa.array([buf.getvalue()], pa.binary())})

        for b in batches:
            for package, path, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if z is None or package != now:
                    if z is not None:
                        yield close()
                    now, buf = package, io.BytesIO()
                    z = zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED)
                z.writestr(zipfile.ZipInfo(path), data or b"", zipfile.ZIP_DEFLATED)
        if z is not None:
            yield close()

    prepare(rows.sparkSession)
    dealt = rows.select(F.col("package").cast("string").alias("package"), order, "content").repartition("package").sortWithinPartitions("package", order)
    return dealt.mapInArrow(run, "package string, content binary")


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file, one line each."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{w}t")).strip() for p in root.iter(f"{w}p"))
    return "\n".join(x for x in lines if x)


def document_texts(files: DataFrame) -> DataFrame:
    """DataFrame[path, text] of files (path, content): DOCX, or plain text."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                raw = data.as_py()
                text = docx_text(raw) if raw[:2] == b"PK" else raw.decode("utf-8", "ignore")
                yield pa.RecordBatch.from_pydict({"path": [name], "text": [text]})

    prepare(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, text string")


def read_documents(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    """DataFrame[path, text]."""
    return document_texts(_files(spark, path, pattern))


def xlsx_rows(data: bytes, sheet: str | None = None) -> list[dict[str, str]]:
    """Rows of the first or the named sheet by header; blank headers are left out,
    short rows filled up."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    r = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{m}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{m}si")]
    sheets = list(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet"))
    chosen = next((s for s in sheets if s.get("name") == sheet), None) if sheet else sheets[0]
    if chosen is None:
        raise ValueError(f"no sheet named {sheet}")
    rels = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    part = rels[chosen.get(r)].lstrip("/")
    table = []
    for row in ET.fromstring(z.read(part if part.startswith("xl/") else f"xl/{part}")).iter(f"{m}row"):
        cells: dict[int, str] = {}
        for c in row.iter(f"{m}c"):
            letters = re.match("[A-Z]+", c.get("r", ""))
            at = 0
            for ch in letters[0] if letters else "":
                at = at * 26 + ord(ch) - 64
            at = at - 1 if letters else len(cells)
            v = c.find(f"{m}v")
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{m}t"))
            elif v is not None and v.text is not None:
                cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
        table.append(cells)
    if not table:
        return []
    heads = {i: h.strip() for i, h in table[0].items() if h.strip()}
    return [{h: cells.get(i, "").strip() for i, h in heads.items()} for cells in table[1:]]


def sheet_rows(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """DataFrame[path, pos, cells map] of XLSX files (path, content)."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = xlsx_rows(data.as_py(), sheet)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([list(r.items()) for r in rows], pa.map_(pa.string(), pa.string()))], names=["path", "pos", "cells"])

    prepare(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, pos long, cells map<string,string>")


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """CSV (with or without a byte order mark) or XLSX tables as strings without white
    space around them. A path may name several files; sheets are read in the tasks,
    and columns that a file lacks are empty in its rows."""
    if path.lower().endswith(".csv"):
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        names = [c.lstrip("\ufeff") for c in df.columns]
        return df.toDF(*(f"c{i}" for i in range(len(names)))).select(*(F.trim(F.coalesce(f"c{i}", F.lit(""))).alias(c) for i, c in enumerate(names)))
    if not path.lower().endswith(".xlsx"):
        raise ValueError(f"neither CSV nor XLSX: {path}")
    rows = sheet_rows(spark.read.format("binaryFile").load(path), sheet)
    first = rows.where("pos = 0").select("path", F.posexplode(F.map_keys("cells")).alias("at", "head"))
    heads = [r.head for r in first.groupBy("head").agg(F.min(F.struct("path", "at")).alias("o")).orderBy("o").collect()]
    if not heads:
        return spark.createDataFrame([], "empty string")
    return rows.select(*(F.coalesce(F.col("cells")[h], F.lit("")).alias(h) for h in heads))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """DataFrame[package, kind, title] of JSON snapshots: modules, pages and so on."""
    item = "array<struct<name:string,title:string>>"
    kinds = {"modules": "module", "pages": "page", "assignments": "assignment", "discussions": "discussion", "announcements": "announcement"}
    schema = "course_id string, " + ", ".join(f"{k} {item}" for k in kinds)
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    parts = [raw.select(F.col("course_id").alias("package"), F.lit(kind).alias("kind"), F.explode(k).alias("x")) for k, kind in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("package", "kind", F.trim(F.coalesce("x.name", "x.title", F.lit(""))).alias("title")).where("title <> ''")


def load_aliases(spark: SparkSession, text: str) -> DataFrame:
    """DataFrame[source, pos, target] of an alias map; values are texts or lists,
    names are basenames in lower case."""
    d = json.loads(text)
    d = d.get("aliases", d)
    name = lambda v: posixpath.basename(str(v).strip().replace("\\", "/")).lower()
    rows = [(name(k), i, name(v)) for k, vs in d.items() for i, v in enumerate([vs] if isinstance(vs, str) else vs)]
    return spark.createDataFrame(rows, "source string, pos int, target string")

"""Texts of packages written as files: lines in, one file a package out.

``write_texts`` deals lines to tasks by package and sorts them there; a task streams them
to a file below a folder of the job, and the commit moves the files to their places. A text
is never put together in memory, so it may be of any length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from packloom.runtime import prepare
from packloom.sources.archive import Writer, Written, _store

NAME = "packloom_text"


class TextWriter(Writer):
    """Lines (package, line) as files; what is open is one file."""

    def __init__(self, options, overwrite: bool):
        super().__init__(options, overwrite)
        self.suffix = options.get("suffix", ".md")
        self.suffixes = (self.suffix.lower(),)

    def write(self, iterator) -> Written:
        store, _ = _store(self.root)
        folder = f"{self.folder}/{uuid.uuid4().hex}"
        store.create_dir(folder)
        moves: list[tuple[str, str]] = []
        now, out = None, None
        try:
            for b in iterator:
                packages, lines = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("package", "line"))
                for package, line in zip(packages, lines):
                    if not package or "/" in package:
                        raise ValueError(f"no name for a file: {package!r}")
                    if package != now:
                        if out is not None:
                            out.close()
                        temp = f"{folder}/{len(moves)}"
                        now, out = package, store.open_output_stream(temp)
                        moves.append((temp, f"{self.at}/{package}{self.suffix}"))
                    else:
                        out.write(b"\n")
                    out.write((line or "").encode())
        finally:
            if out is not None:
                out.close()
        return Written(moves)


class Texts(DataSource):
    """Options: path, suffix."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> TextWriter:
        return TextWriter(self.options, overwrite)


def write_texts(lines: DataFrame, path: str, order: list[str], suffix: str = ".md", overwrite: bool = True) -> None:
    """Lines (package, line and the columns of ``order``) as files ``package + suffix`` in
    the folder ``path``, joined by newlines. A null line is empty; a package without lines
    has no file; a null or empty package is an error."""
    prepare(lines.sparkSession)
    lines.sparkSession.dataSource.register(Texts)
    dealt = lines.select(F.col("package").cast("string").alias("package"), "line", *order).repartition("package").sortWithinPartitions("package", *order)
    dealt.select("package", "line").write.format(NAME).option("suffix", suffix).mode("overwrite" if overwrite else "append").save(path)

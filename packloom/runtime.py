"""Session helpers: where scratch tables go, and how workers find this package."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_local_base: str | None = None
#: Tables written so far, by the frame that reads them, and their paths.
_written: list[tuple[weakref.ref, str]] = []


#: Rows that go to a Python worker at once, at most: buffers of both sides grow with it.
BATCH_ROWS = 2000
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where the repository path exists on them,
    and send them whole texts a bounded number at a time."""
    rows = int(spark.conf.get(_ROWS_CONF, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_ROWS_CONF, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths and os.path.isdir(_ROOT):
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def trim() -> None:
    """Give back to the system, where the C library can, what this worker freed.

    Workers live on from stage to stage, and memory that one of them keeps for later
    is not there for the other tasks of the executor.
    """
    gc.collect()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


#: What this worker keeps from task to task, by who keeps it.
_kept: dict[object, object] = {}


def keep_only(owner: object, make: Callable[[], T] | None = None) -> T | None:
    """In a task: the object that this worker keeps for ``owner``, made if there is none.

    Workers go from stage to stage and from query to query, so what others kept (tables of
    words, codecs) is given back first: a worker holds one owner's object at a time. Without
    ``make`` nothing is kept.
    """
    if _kept and owner not in _kept:
        _kept.clear()
        trim()
    if make is not None and owner not in _kept:
        _kept[owner] = make()
    return _kept.get(owner)


def scratch_base(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    the master is one machine (tests) a folder in the local temp directory is
    used; elsewhere executors would not see each other's files, so that is an error.
    """
    global _local_base
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _local_base is None:
        path = tempfile.mkdtemp(prefix="packloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local_base = f"file:{path}"
    return _local_base


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, keeps the rows compressed, gives the optimizer real
    table sizes, and survives the loss of any executor.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{scratch_base(spark)}/packloom/{app}/{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _written.append((weakref.ref(out), path))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` returned and nothing reads
    any more."""
    for entry in [e for e in _written if e[0]() is df]:
        _written.remove(entry)
        _delete(df.sparkSession, entry[1])


@contextmanager
def scratch(spark: SparkSession):
    """Gives a function that writes a result; when the block ends, every other
    table that was written inside is deleted.

    For a caller that writes an operator's result anyway and needs nothing of what
    the operator wrote on the way.
    """
    before = len(_written)
    kept: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        kept.append(materialise(df, name))
        return kept[-1]

    try:
        yield keep
    finally:
        for entry in _written[before:]:
            if not any(entry[0]() is k for k in kept):
                _written.remove(entry)
                _delete(spark, entry[1])


def drop_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this application."""
    _written.clear()
    _delete(spark, f"{scratch_base(spark)}/packloom/{spark.sparkContext.applicationId}")


def renamed(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with columns ``__c0``, ``__c1``, ..., their former names, and what the
    given ones are called now. Operators work on these, so no name of an extra
    column, whatever it is, meets a name of theirs."""
    names = df.columns
    temp = [f"__c{i}" for i in range(len(names))]
    return df.toDF(*temp), names, [temp[names.index(c)] for c in columns]


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by ``by`` to four tasks a core. A file of a few MB is one task's, however
    many rows it has; what grows from narrow rows, or is slow for each, starts from here."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

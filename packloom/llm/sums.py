"""Sums of long vectors over all tasks, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "block int, values binary"
BLOCK = 16_384


def blocks(values: np.ndarray, size: int = BLOCK) -> pa.RecordBatch:
    """One task's vector as rows of SCHEMA; blocks of zeros are left out, but for
    the last one, which tells the length."""
    flat = np.ascontiguousarray(values, np.float64).ravel()
    at = [i for i in range(0, len(flat), size) if i + size >= len(flat) or flat[i : i + size].any()]
    return pa.RecordBatch.from_arrays([pa.array([i // size for i in at], pa.int32()), pa.array([flat[i : i + size].tobytes() for i in at], pa.binary())], names=["block", "values"])


def sum_vectors(df: DataFrame, size: int = BLOCK) -> np.ndarray:
    """The sum of all tasks' vectors (rows of SCHEMA). It is made in a stream and
    in two levels, so a task holds the blocks it was dealt and no more."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("block").to_pylist(), b.column("values")):
                x = np.frombuffer(v.as_py())
                total[k] = total[k] + x if k in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "values"])

    first = df.withColumn("salt", F.spark_partition_id() % 32).repartition("block", "salt").select("block", "values").mapInArrow(run, SCHEMA)
    rows = {r["block"]: np.frombuffer(r["values"]) for r in first.repartition("block").mapInArrow(run, SCHEMA).collect()}
    if not rows:
        return np.zeros(0)
    last = max(rows)
    return np.concatenate([rows.get(k, np.zeros(size)) for k in range(last)] + [rows[last]])

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packloom.llm import vafile

SCHEMA = "vec_id long, label int, embedding array<float>, row int, x string"


def brute(rows, k=5, low=80):
    good = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, label, v, *_ in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for n, (i, label, v) in enumerate(good):
        if i is None or i % 100:
            continue
        other = [(dot(v, w), j, m) for g, (j, m, w) in enumerate(good) if g != n]
        for p, j, _ in sorted((s for s in other if s[2] == label), key=order)[:k]:
            near = sorted((s for s in other if s[2] != label and low * p <= 100 * s[0] <= 100 * p), key=order)[:k]
            out += [(i, j, r, s[1], p, s[0]) for r, s in enumerate(near, 1)]
    return sorted(map(str, out))


def rows_of(n, seed, width=6, spread=0.3):
    rng = random.Random(seed)
    return [(i, rng.randrange(3), [float(np.float32(rng.gauss(0.2, spread))) for _ in range(width)], 1, "x") for i in range(n)]


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(str(tuple(r)) for r in vafile.mine(df, F.col("vec_id") % 100 == 0, **more).collect())


@pytest.mark.parametrize("block,group", [(8192, 8192), (37, 3)])
def test_equals_all_pairs(spark, monkeypatch, block, group):
    monkeypatch.setattr(vafile, "BLOCK", block)
    rows = rows_of(900, 1)
    got = mined(spark, rows, group=group)
    assert got == brute(rows) and len(got) > 100


def test_ties_nulls_and_hot_vectors(spark):
    hot = [0.5, 0.25, 0.0]
    rows = [(i, i % 2, hot, 1, "x") for i in range(300)] + rows_of(40, 2, 3)
    rows += [(None, 0, hot, 1, None), (400, None, hot, 1, "x"), (500, 1, None, 1, "x"), (600, 1, [0.1, None, 0.2], 1, "x"), (700, 1, [0.1, float("nan"), 0.2], 1, "x"), (800, 1, [float("inf"), 0.0, 0.0], 1, "x")]
    rows += [(100, 0, hot, 1, "x"), (900, 7, hot, 1, "x"), (1000, 1, [0.5], 1, "x"), (1100, 0, [], 1, "x")]
    assert mined(spark, rows) == brute(rows)


def test_empty_and_no_anchor(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [0.5], 1, "x")]) == []


def test_scores_beyond_a_long(spark):
    with pytest.raises(ArithmeticError):
        mined(spark, [(0, 1, [1e30], 1, "x"), (1, 1, [1e30], 1, "x")])


def test_string_keys_and_labels(spark):
    rows = [(f"k{i:04}", "ab"[i % 2], v) for i, (_, _, v, *_) in enumerate(rows_of(200, 3))]
    got = vafile.mine(spark.createDataFrame(rows, "vec_id string, label string, embedding array<double>"), F.col("vec_id") == "k0008").collect()
    assert got and {r.anchor_id for r in got} == {"k0008"} and all(r.positive_id.startswith("k") for r in got)


def test_most_rows_are_pruned():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(0, 0.03, (8192, 16)) + rng.integers(0, 8, 8192)[:, None] * 0.1)).astype(np.int64)
    marks = np.quantile(x, np.arange(1, 16) / 16, axis=0).astype(np.int64).T
    low, high = np.c_[x.min(0), marks], np.c_[marks - 1, x.max(0)]
    cells = vafile.Cells(low, np.maximum(low, high), np.int64)
    block = vafile.Block(cells, np.arange(8192), np.zeros(8192, np.int64), x)
    scored = [block.positives(cells, vafile.Anchor(i, 0, x[i], []), vafile._Best(5)) for i in range(0, 8192, 400)]
    assert sorted(scored)[len(scored) // 2] < 0.15 * 8192

"""Hard negatives of anchors by a vector-approximation file.

Components become whole numbers, ``floor(scale * x)``, and scores are exact inner
products. Each dimension is cut into cells at its quantiles; a row is approximated by
its cells, two dimensions to a byte. An anchor has a table with the least and the
largest product that each byte allows; sums of looked-up entries bound a row's score
from below and above. Only rows whose bounds let them enter what is searched for are
scored exactly:

* positives: a row of the anchor's label whose upper bound reaches the ``positives``-th
  best score or lower bound met so far;
* negatives: a row of another label whose bounds meet a positive's window
  ``low * positive <= 100 * negative <= high * positive`` and whose upper bound reaches
  the ``negatives``-th best in that window, by exact scores and by the lower bounds of
  rows that lie in the window for sure.

So nothing is missed. Anchors go in groups of a bounded size, which are sent to every
task; each task scans its rows once for a group and returns the best of each anchor or
window, and these are merged. Rows are never shuffled but once, to number them in the
order of their keys, by range with ties dealt out.

Defined results: rows with a null label, a null vector, or a null or non-finite component
take no part; a vector that is shorter than others has zeros for what it lacks; ties go
to the smaller key, null keys come last; repeated rows are rows of their own, and an
anchor's positives may have its own key; an anchor without positives, or a positive
without negatives, has no row; a table without anchors gives no rows. Scores have to fit
in 62 bits, else ArithmeticError. Labels are of a whole-number or string type; keys are
of any type that has an order; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packloom.runtime import materialise, prepare, renamed

#: Cells of a dimension; two codes make a byte.
CELLS = 16
#: Anchors that are sent to the tasks at once.
GROUP = 8192
#: Rows that are bounded at once.
BLOCK = 8192


@dataclass
class Cells:
    """Least and largest value of each cell, int64[dimensions, CELLS], with an even
    number of dimensions, and the marks between them."""

    low: np.ndarray
    high: np.ndarray
    kind: type

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Indices into a flat table, one row for two dimensions, of vectors
        int64[rows, dimensions]."""
        c = np.empty((x.shape[1], len(x)), np.int64)
        for d in range(x.shape[1]):
            c[d] = np.searchsorted(self.low[d, 1:], x[:, d], side="right")
        return c[0::2] * CELLS + c[1::2] + np.arange(len(c) // 2)[:, None] * CELLS**2

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat tables of the least and the largest sum of two products with ``q``."""
        a, b = self.low * q[:, None], self.high * q[:, None]
        pair = lambda t: (t[0::2, :, None] + t[1::2, None, :]).ravel().astype(self.kind)
        return pair(np.minimum(a, b)), pair(np.maximum(a, b))


def fit_cells(rows: DataFrame) -> Cells:
    """Cells at the approximate quantiles of each component of ``x``. One row a
    dimension comes to the driver."""
    at = [i / CELLS for i in range(1, CELLS)]
    found = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", at, 1000).alias("marks")).orderBy("d").collect()
    low, high = np.zeros((len(found) + len(found) % 2, CELLS), np.int64), np.zeros((len(found) + len(found) % 2, CELLS), np.int64)
    largest = 0
    for r in found:
        least, most = min(r.least, 0), max(r.most, 0)
        low[r.d] = [least, *r.marks]
        high[r.d] = [*(m - 1 for m in r.marks), most]
        largest += max(-least, most) ** 2
    if largest >= 1 << 62:
        raise ArithmeticError("scores of these vectors do not fit in a long")
    # A cell between equal marks holds no value; its bounds are never looked up.
    high = np.maximum(low, high)
    return Cells(low, high, np.int32 if largest < 1 << 30 else np.int64)


@dataclass
class Anchor:
    row: int
    label: object
    q: np.ndarray
    windows: list[tuple[int, int, int]]


class _Best:
    """The first ``k`` of what was met, by score and then row."""

    def __init__(self, k: int):
        self.k, self.score, self.row = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int | None:
        return int(self.score[-1]) if len(self.score) == self.k else None

    def add(self, score: np.ndarray, row: np.ndarray) -> None:
        score, row = np.concatenate([self.score, score]), np.concatenate([self.row, row])
        first = np.lexsort((row, -score))[: self.k]
        self.score, self.row = score[first], row[first]


def _kth(values: np.ndarray, k: int) -> int | None:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


class Block:
    """Rows of one label after another, their codes and vectors."""

    def __init__(self, cells: Cells, row: np.ndarray, label: np.ndarray, x: np.ndarray):
        order = np.argsort(label, kind="stable")
        self.row, self.x = row[order], x[order]
        values, first = np.unique(label[order], return_index=True)
        ends = [*first[1:], len(order)]
        self.part = {v: (int(a), int(b)) for v, a, b in zip(values.tolist(), first, ends)}
        self.codes = cells.codes(self.x)

    def positives(self, cells: Cells, a: Anchor, best: _Best) -> int:
        """Adds what may be among the best; gives the number of exact scores."""
        s, e = self.part.get(a.label, (0, 0))
        if s == e:
            return 0
        low, high = cells.tables(a.q)
        codes, other = self.codes[:, s:e], self.row[s:e] != a.row
        upper = high[codes].sum(0)
        least = best.floor()
        sure = _kth(low[codes].sum(0)[other], best.k)
        for bound in (least, sure):
            if bound is not None:
                other &= upper >= bound
        at = s + np.flatnonzero(other)
        if len(at):
            best.add(self.x[at] @ a.q, self.row[at])
        return len(at)

    def negatives(self, cells: Cells, a: Anchor, best: dict[int, _Best]) -> int:
        low, high = cells.tables(a.q)
        upper, lower = high[self.codes].sum(0), low[self.codes].sum(0)
        open_ = (upper >= min(w[1] for w in a.windows)) & (lower <= max(w[2] for w in a.windows))
        s, e = self.part.get(a.label, (0, 0))
        open_[s:e] = False
        at = np.flatnonzero(open_)
        upper, lower = upper[at], lower[at]
        wanted = np.zeros(len(at), bool)
        for p, least, most in a.windows:
            floor = max(least, *(b for b in (best[p].floor(), _kth(lower[(lower >= least) & (upper <= most)], best[p].k)) if b is not None), least)
            wanted |= (upper >= floor) & (lower <= most)
        at = at[wanted]
        score = self.x[at] @ a.q
        for p, least, most in a.windows:
            inside = (score >= least) & (score <= most)
            if inside.any():
                best[p].add(score[inside], self.row[at[inside]])
        return len(at)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """int64[rows, width] of lists, shorter ones filled with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(batches, cells: Cells):
    held: list[pa.RecordBatch] = []

    def block() -> Block:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        column = lambda n: t.column(n).chunk(0)
        label = column("label").to_numpy(zero_copy_only=False)
        return Block(cells, column("row").to_numpy(), label, _vectors(column("x"), len(cells.low)))

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK:
            yield block()
    if held:
        yield block()


def _scan(rows: DataFrame, cells: Cells, anchors: list[Anchor], k: int, windows: bool) -> DataFrame:
    """DataFrame[anchor, window, score, found]: the first ``k`` of each anchor (its
    positives, window 0) or of each of its windows."""
    sent = rows.sparkSession.sparkContext.broadcast((cells, anchors))

    def run(batches):
        cells, anchors = sent.value
        best = [{w[0]: _Best(k) for w in a.windows} if windows else {0: _Best(k)} for a in anchors]
        for block in _blocks(batches, cells):
            for a, b in zip(anchors, best):
                if windows:
                    block.negatives(cells, a, b)
                else:
                    block.positives(cells, a, b[0])
        for a, found in zip(anchors, best):
            for w, b in found.items():
                if len(b.row):
                    n = len(b.row)
                    yield pa.RecordBatch.from_arrays([pa.array([a.row] * n, pa.int64()), pa.array([w] * n, pa.int64()), pa.array(b.score, pa.int64()), pa.array(b.row, pa.int64())], names=["anchor", "window", "score", "found"])

    found = rows.mapInArrow(run, "anchor long, window long, score long, found long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, group: int = GROUP) -> DataFrame:
    """DataFrame[anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score] for the rows where ``anchors``, a condition on the columns of
    ``df``, holds."""
    spark = df.sparkSession
    prepare(spark)
    marked = df.withColumns({"__anchor": F.coalesce(anchors, F.lit(False))})
    work, _, (k, l, v, a) = renamed(marked, key, label, vector, "__anchor")
    finite = lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))
    x = F.transform(v, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long"))
    part = work.where(F.col(l).isNotNull() & F.col(v).isNotNull() & F.forall(v, finite))
    part = part.select(F.col(k).alias("key"), F.col(l).alias("label"), x.alias("x"), F.col(a).alias("is_anchor"), F.monotonically_increasing_id().alias("tie"))
    # Numbers in the order of keys; equal keys are dealt out over the range as well.
    order = [F.asc_nulls_last("key"), F.asc("tie")]
    numbered = part.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()).drop("tie")
    rows = materialise(numbered, "va-file")
    out = "anchor_row long, positive_row long, rank int, negative_row long, positive_score long, negative_score long"
    result = spark.createDataFrame([], out)
    n = rows.where("is_anchor").count()
    if n:
        cells = fit_cells(rows)
        groups = -(-n // group)
        scanned = rows.select("row", "label", "x")
        for g in range(groups):
            some = rows.where(F.col("is_anchor") & (F.pmod(F.xxhash64("row"), F.lit(groups)) == g)).select("row", "label", "x").collect()
            sent = []
            for r in some:
                q = np.zeros(len(cells.low), np.int64)
                q[: len(r.x)] = r.x
                sent.append(Anchor(r.row, r.label, q, []))
            near = materialise(_scan(scanned, cells, sent, positives, False).select("anchor", "score", "found"), "va-positives")
            windows: dict[int, set[int]] = {}
            for r in near.select("anchor", "score").distinct().collect():
                windows.setdefault(r.anchor, set()).add(r.score)
            for s in sent:
                # Scores n with low * p <= 100 n <= high * p.
                every = [(p, -(-low * p // 100), high * p // 100) for p in sorted(windows.get(s.row, ()))]
                s.windows = [w for w in every if w[1] <= w[2]]
            sent = [s for s in sent if s.windows]
            if sent:
                far = _scan(scanned, cells, sent, negatives, True)
                both = near.withColumnsRenamed({"score": "positive_score", "found": "positive_row"}).join(far.withColumnsRenamed({"score": "negative_score", "found": "negative_row"}), (near["anchor"] == far["anchor"]) & (F.col("positive_score") == F.col("window")))
                result = result.unionAll(both.select(near["anchor"].alias("anchor_row"), "positive_row", F.col("rank").cast("int").alias("rank"), "negative_row", "positive_score", "negative_score"))
    for side in ("anchor", "positive", "negative"):
        result = result.join(rows.select(F.col("row").alias(f"{side}_row"), F.col("key").alias(f"{side}_id")), f"{side}_row")
    return result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

"""Passages of words that stand in more than one document.

A passage is ``length`` or more words in a row (between white space, A-Z without
regard to case). Every window of ``length`` words is given to an anchor, the leftmost
smallest hash among the GRAM-grams of words inside it; the windows of one anchor are
consecutive, and with ``length - 1`` more words they form its context. So equal windows
of two documents have equal anchors:

1. Anchors that only one document has are dropped.
2. Where all contexts of an anchor are equal, all their windows are shared.
3. Of all others each distinct context is taken apart into its windows, whose hashes are
   counted by distinct documents.

Words, contexts and windows are told by 64-bit hashes, windows also by their anchor and
its place. A row is told by a hash of the hashes of its key and of its text, so a row
that occurs again with both is the same document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.lblm import portions, split
from packloom.llm.substr import _sliding_min
from packloom.runtime import drop_table, materialise, prepare

GRAM = 8
_CHUNK = 1 << 22
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_LOW = np.uint64((1 << 24) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Sequences:
    """Hashes of any ranges of a sequence, by sums of its prefixes modulo 2 ** 64."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.back = _powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(base, n), out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


def word_hashes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    size = pc.binary_length(words).to_numpy()
    ends = np.cumsum(size, dtype=np.int64)
    _, offsets, text = words.buffers()
    data = np.frombuffer(text, np.uint8, int(ends[-1]), np.frombuffer(offsets, np.int32)[words.offset])
    return _mixed(_Sequences(data.astype(np.uint64) + np.uint64(1), _P).hashes(ends - size, ends) + size.astype(np.uint64))


def runs(words: np.ndarray, each: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts with ``each`` of the hashes of words: of each anchor its text's place, its
    hash, that of its context, its first window, and the number of its windows."""
    gram = min(GRAM, length)
    out = []
    stop = np.repeat(np.cumsum(each), each)
    for at in range(0, max(0, len(words) - length + 1), _CHUNK):
        part = words[at : at + _CHUNK + length - 1]
        seq = _Sequences(part, _Q)
        i = np.arange(len(part) - gram + 1)
        h = seq.hashes(i, i + gram)
        owner = (_sliding_min((h & ~_LOW) | i.astype(np.uint64), length - gram + 1) & _LOW).astype(np.int64)
        start = np.flatnonzero(stop[at : at + len(owner)] - at - np.arange(len(owner)) >= length)
        if len(start):
            owner = owner[start]
            cut = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]])
            first, last = start[cut[:-1]], start[cut[1:] - 1]
            out.append((first + at, h[owner[cut[:-1]]].view(np.int64), seq.hashes(first, last + length).view(np.int64), last - first + 1))
    if not out:
        return (np.zeros(0, np.int64),) * 5
    first, anchor, ctx, n = (np.concatenate(x) for x in zip(*out))
    text = np.searchsorted(np.cumsum(each), first, "right")
    return text, anchor, ctx, first - (np.cumsum(each) - each)[text], n


def _find(plain: DataFrame, length: int) -> DataFrame:
    names = ["row", "anchor", "ctx", "s", "n"]

    def run(batches):
        for batch in batches:
            for part in portions(batch, 1):
                words, each = split(part.column(1))
                text, *found = runs(word_hashes(words), each, length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part.column(0).to_numpy()[text], *found)], names=names)

    prepare(plain.sparkSession)
    return plain.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """Rows with a text and ``need`` array<struct<anchor, ctx, s, n, lo, hi>> to a row for
    each window of these contexts with its hash."""
    names = ["anchor", "ctx", "w", "h", "lo", "hi"]

    def run(batches):
        for batch in batches:
            for part in portions(batch):
                words, each = split(part.column(0))
                need = part.column(1)
                per = pc.list_value_length(need).to_numpy()
                of = {f.name: need.flatten().field(i).to_numpy() for i, f in enumerate(need.type.value_type)}
                n = of["n"]
                first = np.repeat(np.cumsum(each) - each, per) + of["s"]
                w = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(first, n) + w
                h = _Sequences(word_hashes(words), _Q).hashes(start, start + length).view(np.int64)
                rest = {k: np.repeat(of[k], n) for k in ("anchor", "ctx", "lo", "hi")}
                c = rest | {"w": w, "h": h}
                yield pa.RecordBatch.from_arrays([pa.array(c[k]) for k in names], names=names)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _covered(rows: DataFrame, length: int) -> DataFrame:
    """Rows with the first words of windows to the number of words in them."""

    def run(batches):
        for batch in batches:
            starts = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(starts).to_numpy())
            start = starts.flatten().to_numpy()
            order = np.lexsort((start, row))
            row, start = row[order], start[order]
            n = np.full(len(row), length)
            n[:-1] = np.where(row[1:] == row[:-1], np.minimum(np.diff(start), length), length)
            total = np.bincount(row, n, batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total)], names=["row", "n_shared_words"])

    return rows.mapInArrow(run, "row long, n_shared_words long")


def shared_words(plain: DataFrame, length: int) -> DataFrame:
    """DataFrame[row, n_shared_words], row the hash of key and tkey: the words in passages of ``length`` words or
    more that another document has too, of rows (key, tkey, text) that have such words."""
    plain = plain.select(F.xxhash64("key", "tkey").alias("row"), "key", "tkey", "text")
    found = materialise(_find(plain.select("row", "text"), length), "passage-runs")
    # Most anchors have one document; they go before anything else is done.
    shared = found.groupBy("anchor").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo <> hi").select("anchor")
    # Read from a table, so a join by an anchor of many documents can be split.
    shared = materialise(shared, "passage-anchors")
    every = materialise(found.join(shared, "anchor"), "passages-shared")
    drop_table(found)
    # The fields of one occurrence are taken together: they are all first values.
    sums = every.groupBy("anchor", "ctx").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), *(F.first(c).alias(c) for c in ("row", "s", "n")))
    anchors = every.groupBy("anchor").agg((F.min("ctx") != F.max("ctx")).alias("differ"))
    needed = materialise(sums.join(anchors, "anchor"), "passages-needed")
    whole = needed.where("not differ").select("anchor", "ctx", F.sequence(F.lit(0).cast("long"), F.col("n") - 1).alias("places"))
    listed = needed.where("differ").groupBy("row").agg(F.collect_list(F.struct("anchor", "ctx", "s", "n", "lo", "hi")).alias("need"))
    windows = materialise(_windows(plain.join(listed, "row").select("text", "need"), length), "passage-windows")
    shared = windows.groupBy("anchor", "h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("anchor", "h")
    found = windows.join(shared, ["anchor", "h"]).groupBy("anchor", "ctx").agg(F.collect_list("w").alias("places"))
    starts = every.join(found.unionAll(whole), ["anchor", "ctx"]).select("row", F.transform("places", lambda w: F.col("s") + w).alias("starts"))
    return _covered(starts.groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts")), length)

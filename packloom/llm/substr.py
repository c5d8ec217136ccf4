"""Removal of repeated substrings: every byte covered by a string of ``length``
bytes that also starts anywhere else in the corpus, found by suffix arrays.

1. Every window of ``length`` bytes is given to an anchor, the leftmost smallest
   hash among the k-grams inside it, which depends on the window's bytes alone.
   The windows of one anchor are consecutive; with ``length - 1`` more bytes they
   form its context. Each row keeps only hashes and positions.
2. Contexts are summed by (anchor hash, context hash). Where an anchor hash
   occurs once, none of its windows repeats; where all its contexts are one, all
   do. All others go on, one row for each distinct context with the number of its
   occurrences.
3. Their bytes are read and dealt to shards by anchor hash, so that equal windows
   meet in one shard. A shard's suffix array (induced sorting) and permuted
   common prefixes give the groups of windows that agree in ``length`` bytes; a
   window is repeated if its group occurs more than once.
4. An anchor hash whose contexts outgrow a shard is cut into blocks, and every
   pair of its blocks becomes a shard, as long as it has at most ``HOT_BLOCKS``
   blocks, so a context is sent a bounded number of times.
5. Windows of an anchor hash that has more are told apart by 128-bit hashes. Equal
   windows have their anchor in the same place, so CORE windows with neighbouring
   places share a core of ``length - CORE + 1`` bytes; windows whose core occurs once
   are done, and the others are counted one by one. This is linear in the contexts.
6. Repeated windows go back to the rows, where they are merged and cut out.

Defined results: a null text is the empty text; equal texts repeat each other
and lose all windows; texts shorter than ``length`` bytes lose nothing; repeated
and null keys are rows like others; extra columns are ignored. A row is told by the
64-bit hashes of its key and of its text, a context by those of its anchor and itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.suffix import permuted_lcp, suffix_array
from packloom.runtime import drop_table, materialise, prepare, renamed

LENGTH = 400
SHARD_BYTES = 1 << 20
HOT_BLOCKS = 16
CORE = 16
_P = 0x9E3779B97F4A7C15
_CHUNK = 1 << 22


def _gram(length: int) -> int:
    return max(2, length * 4 // 25)


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram: bytes are paired, then pairs of pairs, and
    so on, so a gram of k bytes takes about log2 k array operations."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_P)
        size = 1
        out, done = None, 0
        n = len(data) - k + 1
        while True:
            if k & size:
                part = h[done : done + n]
                out = part.copy() if out is None else (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part
                done += size
            size *= 2
            if size > k:
                break
            h = (h[: -(size // 2)] ^ (h[: -(size // 2)] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + h[size // 2 :]
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(27))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x)
    if w == 1:
        return x.copy()
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    fwd = np.minimum.accumulate(y, 1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], fwd[w - 1 : n])


def runs(data: bytes, length: int) -> list[tuple[int, int, int, int, int]]:
    """(anchor hash, context hash, first window, number of windows, place of the
    anchor after the first window's start) of each anchor; the windows of all runs
    are all windows, each once."""
    import xxhash

    k = _gram(length)
    out = []
    windows = len(data) - length + 1
    for at in range(0, max(0, windows), _CHUNK):
        part = np.frombuffer(data, np.uint8, min(_CHUNK, windows - at) + length - 1, at)
        h = _gram_hashes(part, k)
        low = np.uint64((1 << 24) - 1)
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        best = _sliding_min(packed, length - k + 1)
        owner = (best & low).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]])
        anchors = h[owner[cut[:-1]]].view(np.int64).tolist()
        places = (owner[cut[:-1]] - cut[:-1]).tolist()
        cut = (cut + at).tolist()
        for a, off, s, e in zip(anchors, places, cut, cut[1:]):
            c = xxhash.xxh3_64_intdigest(data[s : e + length - 1])
            out.append((a, c - (1 << 64) if c >> 63 else c, s, e - s, off))
    return out


def repeated_windows(contexts: list[tuple[bytes, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each (bytes, windows, occurrences): the ranges [a, b) of its windows
    that occur more than once among all contexts."""
    starts, at = [], 0
    for c, _, _ in contexts:
        starts.append(at)
        at += len(c)
    data = np.frombuffer(b"".join(c for c, _, _ in contexts), np.uint8)
    weight = np.zeros(len(data), np.int64)
    for s, (_, n, times) in zip(starts, contexts):
        weight[s : s + n] = times
    sa = suffix_array(data)
    new = permuted_lcp(data, sa)[sa] < length
    new[0] = True
    first = np.flatnonzero(new)
    total = np.add.reduceat(weight[sa], first)
    group = np.cumsum(new) - 1
    repeated = np.zeros(len(data), bool)
    repeated[sa] = total[group] > 1
    repeated &= weight > 0
    out = []
    for s, (_, n, _) in zip(starts, contexts):
        r = np.concatenate([[False], repeated[s : s + n], [False]])
        edge = np.flatnonzero(r[1:] != r[:-1]).tolist()
        out.append(list(zip(edge[::2], edge[1::2])))
    return out


def _find_runs(plain: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for key, tkey, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    rows += [(key, tkey, *r) for r in runs((text or "").encode("utf-8"), length)]
                c = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["key", "tkey", "anchor", "ctx", "s", "n", "off"])

    prepare(plain.sparkSession)
    return plain.mapInArrow(run, "key long, tkey long, anchor long, ctx long, s long, n long, off long")


def _read_contexts(rows: DataFrame, length: int) -> DataFrame:
    """Rows with a text and ``need`` array<struct<anchor, ctx, s, n, off, times,
    blocks>> to one row per context with its bytes."""
    schema = "anchor long, ctx long, n long, off long, times long, blocks long, bytes binary"
    names = ["anchor", "ctx", "n", "off", "times", "blocks", "bytes"]
    types = [pa.int64()] * 6 + [pa.binary()]

    def run(batches):
        def done(out):
            c = list(zip(*out)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names=names)

        out, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for text, need in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = (text or "").encode("utf-8")
                    for r in need:
                        out.append((r["anchor"], r["ctx"], r["n"], r["off"], r["times"], r["blocks"], data[r["s"] : r["s"] + r["n"] + length - 1]))
                        size += r["n"] + length
                        if size > 4 << 20:
                            yield done(out)
                            out, size = [], 0
        yield done(out)

    return rows.mapInArrow(run, schema)


def _search(contexts: DataFrame, length: int, shards: int) -> DataFrame:
    """DataFrame[anchor, ctx, a, b]: ranges of repeated windows of contexts."""
    b = F.pmod(F.xxhash64("ctx"), F.col("blocks")).cast("long")
    seq = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pairs = F.transform(seq, lambda j: F.struct(F.col("anchor").alias("shard"), F.least(b, j).alias("i"), F.greatest(b, j).alias("j")))
    small = F.array(F.struct(F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("long").alias("shard"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j")))
    dealt = contexts.withColumn("p", F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(small))).select("p.*", "anchor", "ctx", "n", "times", "bytes")
    cols = ["shard", "i", "j"]
    dealt = dealt.repartition(*cols).sortWithinPartitions(*cols)

    def run(batches):
        def solve(rows):
            keys = list(rows)
            got = repeated_windows([rows[k] for k in keys], length)
            flat = [(*k, x, y) for k, ranges in zip(keys, got) for x, y in ranges]
            c = list(zip(*flat)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["anchor", "ctx", "a", "b"])

        current, rows = None, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                d = batch.slice(at, 1024).to_pydict()
                for *key, anchor, ctx, n, times, data in zip(*(d[c] for c in [*cols, "anchor", "ctx", "n", "times", "bytes"])):
                    if key != current:
                        if rows:
                            yield solve(rows)
                        current, rows = key, {}
                    rows[anchor, ctx] = (data, n, times)
        if rows:
            yield solve(rows)

    return dealt.mapInArrow(run, "anchor long, ctx long, a long, b long")


def _hashes(contexts: DataFrame, length: int, size: int, groups: str | None) -> DataFrame:
    """DataFrame[anchor, ctx, times, g, h1, h2]: hashes of the cores of ``size``
    windows whose anchors stand ``g * size`` and more bytes after their start, of all
    groups or of those listed in a column."""
    import xxhash

    names = ["anchor", "ctx", "times", "g", "h1", "h2"]
    cols = ["anchor", "ctx", "times", "n", "off", "bytes", *([groups] if groups else [])]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for anchor, ctx, times, n, off, data, *listed in zip(*(batch.slice(at, 256).column(c).to_pylist() for c in cols)):
                    low, high = off - n + 1, off  # the places of the anchor in these windows
                    for g in (sorted(listed[0]) if listed else range(low // size, high // size + 1)):
                        if listed and not low <= g * size <= high:
                            continue
                        h = xxhash.xxh3_128_digest(data[max(0, off - g * size) : off - g * size - size + 1 + length])
                        out.append((anchor, ctx, times, g, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)))
                c = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=names)

    return contexts.select(cols).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _shared(hashes: DataFrame, name: str) -> DataFrame:
    """The rows of ``hashes`` whose hash occurs more than once. Sums and rows are read
    from tables, so a hash that many contexts share is a join that can be split."""
    by = ["anchor", "g", "h1", "h2"]
    hashes = materialise(hashes, name)
    often = materialise(hashes.groupBy(*by).agg(F.sum("times").alias("all")).where("all > 1").drop("all"), name)
    return hashes.join(often, by).select("anchor", "ctx", "g")


def _count_windows(contexts: DataFrame, length: int, core: int = CORE) -> DataFrame:
    """DataFrame[anchor, ctx, a, b]: ranges of repeated windows, by counts of hashes."""
    cores = _shared(_hashes(contexts, length, core, None), "window-cores")
    spread = F.transform(F.sequence(F.lit(0), F.lit(core - 1)), lambda i: F.col("g") * core + i)
    listed = cores.groupBy("anchor", "ctx").agg(F.flatten(F.collect_list(spread)).alias("places"))
    windows = _shared(_hashes(contexts.join(listed, ["anchor", "ctx"]), length, 1, "places"), "windows")
    found = windows.groupBy("anchor", "ctx").agg(F.sort_array(F.collect_list("g")).alias("places"))
    found = found.join(contexts.select("anchor", "ctx", "off"), ["anchor", "ctx"])

    def run(batches):
        for batch in batches:
            out = []
            for anchor, ctx, places, off in zip(*(batch.column(c).to_pylist() for c in ("anchor", "ctx", "places", "off"))):
                at = off - np.array(places[::-1])
                cut = np.flatnonzero(np.diff(at) > 1) + 1
                out += [(anchor, ctx, int(x[0]), int(x[-1]) + 1) for x in np.split(at, cut)]
            c = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["anchor", "ctx", "a", "b"])

    return found.mapInArrow(run, "anchor long, ctx long, a long, b long")


def _cut(rows: DataFrame, key: str, kind: str, length: int, with_text: bool) -> DataFrame:
    more = rows.columns[3:]  # longs that are handed on
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text + more

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = (text or "").encode("utf-8")
                    kept, end, removed, spans = [], 0, 0, 0
                    for r in sorted((r["a"], r["b"]) for r in ranges or ()):
                        if r[0] > end or not spans:
                            kept.append(data[end : r[0]])
                            spans += 1
                            end = r[0]
                        removed += max(0, r[1] - end)
                        end = max(end, r[1])
                    kept = b"".join([*kept, data[end:]])
                    out.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest()) + (kept,) * with_text)
                types = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * with_text
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*out), types)), *(part.column(3 + i) for i in range(len(more)))], names=names)

    return rows.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text + "".join(f", {c} long" for c in more))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot_blocks: int = HOT_BLOCKS, with_text: bool = False, passage_words: int | None = None) -> DataFrame:
    """DataFrame[key, n_bytes, n_removed, n_spans, kept_sha256], with the bytes
    that remain if ``with_text`` is set. With ``passage_words`` also n_shared_words, the
    words in passages of so many words or more that another document has too; many of
    these are shorter than ``length`` bytes, and nothing is removed for them."""
    docs, _, (k, t) = renamed(docs, key, text)
    plain = docs.select(F.xxhash64(k).alias("key"), F.xxhash64(t).alias("tkey"), F.col(t).alias("text"))
    every = materialise(_find_runs(plain, length), "runs")
    # The fields of one occurrence are taken together: they are all first values.
    sums = every.groupBy("anchor", "ctx").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("key", "tkey", "s", "n", "off")))
    sums = materialise(sums, "run-sums")
    size = (F.col("n") + length - 1).cast("long")
    anchors = sums.groupBy("anchor").agg(F.sum("times").alias("all"), F.sum(size).alias("bytes"), F.count("*").alias("contexts")).where("all > 1")
    anchors = anchors.select("anchor", "contexts", F.when(F.col("bytes") > shard_bytes, F.ceil(2 * F.col("bytes") / shard_bytes)).otherwise(1).cast("long").alias("blocks"))
    need = materialise(sums.join(anchors, "anchor"), "contexts-needed")
    drop_table(sums)
    alone, need = need.where("contexts = 1"), need.where("contexts > 1")
    total, most = need.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    by_text = need.groupBy("key", "tkey").agg(F.collect_list(F.struct("anchor", "ctx", "s", "n", "off", "times", "blocks")).alias("need"))
    contexts = _read_contexts(plain.join(by_text, ["key", "tkey"]).select("text", "need"), length)
    if most > hot_blocks:
        contexts = materialise(contexts, "contexts")
    found = _search(contexts.where(F.col("blocks") <= hot_blocks), length, int(total // shard_bytes) + 1)
    if most > hot_blocks:
        found = found.unionAll(_count_windows(contexts.where(F.col("blocks") > hot_blocks), length))
    # A context that occurs again and is its anchor's only one repeats in all its windows.
    found = found.unionAll(alone.select("anchor", "ctx", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    found = materialise(found, "repeats")
    # Rows are told by key and text: a text that many rows have is many groups.
    row = ["key", "tkey"]
    spans = every.join(found, ["anchor", "ctx"]).select(*row, F.struct((F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b") + length - 1).alias("b")).alias("r"))
    spans = spans.groupBy(*row).agg(F.collect_set("r").alias("ranges"))
    if passage_words:
        from packloom.llm.passages import shared_words

        words = shared_words(plain, passage_words).withColumnRenamed("row", "r")
        spans = spans.withColumn("r", F.xxhash64(*row)).join(words, "r", "full").drop(*row).withColumnRenamed("r", "row")
    rows = docs.select(F.col(k).alias("__k"), F.xxhash64(k).alias("key"), F.xxhash64(t).alias("tkey"), F.col(t).alias("text"))
    if passage_words:
        rows = rows.withColumn("row", F.xxhash64(*row))
        row = ["row"]
    rows = rows.join(spans, row, "left")
    rows = rows.select("__k", "text", "ranges", *([F.coalesce("n_shared_words", F.lit(0)).alias("n_shared_words")] if passage_words else []))
    return _cut(rows, key, dict(docs.dtypes)[k], length, with_text)

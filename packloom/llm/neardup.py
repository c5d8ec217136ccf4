"""Similarity join on word shingles, with Bayesian pruning of candidates.

Words are runs of non-white space, lower-cased for A-Z; a document's set has its
shingles of five words, or one shingle of all words if it has fewer. Documents
with equal sets are one node from the start. Nodes that share a MinHash band are
candidates; they are linked to the smallest node of the band, which connects all
of them, and the connected components of that graph are compared inside, block
by block. There, the MinHash values of a pair are compared a few at a time, and
the pair is dropped as soon as the posterior probability that its Jaccard
similarity reaches the threshold, after m matches in h values under a uniform
prior, falls below ``tolerance``. Every pair that is left is verified exactly on
the shingle sets.

A pair at 0.8 shares no band with probability below 4e-7; at the default
tolerance pruning loses about as few.

Defined results: a document without words (null, empty, white space) is a class
of its own with no links; equal rows are links of each other; repeated keys count
as documents; extra columns are ignored; a class is named by its smallest key.
An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.graph import components
from packloom.runtime import keep_only, materialise, prepare, renamed, trim

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 4
VALUES, STEP = 96, 16
TOLERANCE = 1e-6
BLOCK = 1024
_M = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) > 300_000:
            self.clear()
        self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(min(len(w), width)))
        for i in range(min(len(w), width)):
            h = h * _M + w[i : i + n]
        return np.unique(_mix(h))


def _coefficients(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def minhash(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 32-bit value per hash function."""
    out = np.full(len(a), np.uint32(0xFFFFFFFF))
    with np.errstate(over="ignore"):
        for i in range(0, len(sh), 4096):
            h = (a[:, None] * sh[None, i : i + 4096] + b[:, None]) >> np.uint64(32)
            out = np.minimum(out, h.min(1).astype(np.uint32))
    return out


def least_matches(threshold: float, tolerance: float, values: int, step: int) -> list[int]:
    """For h = step, 2 step, ...: the fewest matches with P(J >= threshold | m
    of h) >= tolerance. Under a uniform prior J is Beta(m + 1, h - m + 1), whose
    upper tail is a sum of binomial terms."""
    out = []
    for h in range(step, values + 1, step):
        n, tail = h + 1, 0.0
        for m in range(h + 1):
            tail += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
            if tail >= tolerance:
                out.append(m)
                break
    return out


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs (i of ``left``, j of ``right``, each pair once) with
    Jaccard similarity of at least ``threshold``."""
    a, b = _coefficients(VALUES, 11)
    sig = np.stack([minhash(s, a, b) for s in sets])
    size = np.array([len(s) for s in sets])
    least = least_matches(threshold, tolerance, VALUES, STEP)
    same = left is right
    keep_i, keep_j = [], []
    for at in range(0, len(left), 256):  # bounded memory: 256 rows against all
        li = left[at : at + 256]
        i, j = np.repeat(li, len(right)), np.tile(right, len(li))
        ok = (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])) & ((i < j) if same else (i != j))
        i, j = i[ok], j[ok]
        matches = np.zeros(len(i), np.int32)
        for s, need in enumerate(least):
            cut = slice(s * STEP, (s + 1) * STEP)
            for k in range(0, len(i), 200_000):
                p = slice(k, k + 200_000)
                matches[p] += (sig[i[p], cut] == sig[j[p], cut]).sum(1, dtype=np.int32)
            ok = matches >= need
            i, j, matches = i[ok], j[ok], matches[ok]
            if not len(i):
                break
        keep_i.append(i)
        keep_j.append(j)
    i, j = np.concatenate(keep_i), np.concatenate(keep_j)
    if not len(i):
        return i, j
    inter = _intersections(sets, i, j)
    ok = inter >= threshold * (size[i] + size[j] - inter) - 1e-9
    return i[ok], j[ok]


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of intersections, pair by pair or, if there are many pairs
    among few sets, by matrix products over the shingles that sets share."""
    used = np.unique(np.concatenate([i, j]))
    if len(i) < 20 * len(used):
        out = np.empty(len(i), np.int64)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            s, t = sets[x], sets[y]
            pos = np.searchsorted(t, s)
            pos[pos == len(t)] = 0
            out[k] = np.count_nonzero(t[pos] == s)
        return out
    flat = np.concatenate([sets[x] for x in used])
    row = np.repeat(np.arange(len(used)), [len(sets[x]) for x in used])
    _, term, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[term] > 1
    row, term = row[shared], np.unique(term[shared], return_inverse=True)[1]
    order = np.argsort(term, kind="stable")
    row, term = row[order], term[order]
    total = np.zeros((len(used), len(used)), np.float32)
    width = 4096
    for c in range(0, int(term[-1]) + 1 if len(term) else 0, width):
        lo, hi = np.searchsorted(term, [c, c + width])
        x = np.zeros((len(used), width), np.float32)
        x[row[lo:hi], term[lo:hi] - c] = 1
        total += x @ x.T
    return total[np.searchsorted(used, i), np.searchsorted(used, j)].astype(np.int64)


def _sets(df: DataFrame, width: int) -> DataFrame:
    """DataFrame[key, tkey, node, n, bands]: what the first pass keeps of a row."""

    def run(batches):
        keep_only("jaccard_join")
        hashes = _WordHashes()
        a, b = _coefficients(BANDS * ROWS, 5)
        band = np.arange(1, BANDS + 1, dtype=np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                nodes, ns, bands = [], [], []
                for t in part.column(2):
                    sh = shingles(t.as_py(), hashes, width)
                    ns.append(len(sh))
                    if not len(sh):
                        nodes.append(None)
                        bands.append(None)
                        continue
                    nodes.append(set_id(sh))
                    m = minhash(sh, a, b).reshape(BANDS, ROWS).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        h = band * _M
                        for r in range(ROWS):
                            h = _mix(h * _M + m[:, r])
                    bands.append(h.view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(ns, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=["key", "tkey", "node", "n", "bands"])
        hashes.clear()
        trim()

    prepare(df.sparkSession)
    return df.mapInArrow(run, "key long, tkey long, node long, n int, bands array<long>")


def set_id(sh: np.ndarray) -> int:
    """64 bits of a digest of the set; equal ids are taken as equal sets."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(sh.tobytes(), digest_size=8).digest(), "little", signed=True)


def _members(docs: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """DataFrame[of, node, root, copies, pair, side]: each node once for every
    pair of blocks of its component that it takes part in.

    A component of more than BLOCK nodes is cut into classes of set size, a
    factor of 1 / threshold wide, so that only equal and adjacent classes can
    hold similar pairs, and each class into blocks by a hash of the node.
    """
    m = nodes.join(roots, "node")
    count = m.groupBy("root").agg(F.count("*").alias("c"))
    m = m.join(count, "root")
    klass = F.when(F.col("c") > BLOCK, F.floor(F.log(F.col("n").cast("double")) / math.log(1 / THRESHOLD) + 1e-9)).otherwise(F.lit(0)).cast("int")
    m = materialise(m.withColumn("k", klass), "near-members")
    blocks = m.groupBy("root", "k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    blocks = materialise(blocks, "near-blocks")
    own = blocks.select("root", "k", F.col("nb").alias("own"))
    up = blocks.select("root", (F.col("k") - 1).alias("k"), F.col("nb").alias("up"))
    down = blocks.select("root", (F.col("k") + 1).alias("k"), F.col("nb").alias("down"))
    dims = own.join(up, ["root", "k"], "left").join(down, ["root", "k"], "left")
    m = m.join(dims, ["root", "k"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
    seq = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda k1, i1, k2, i2, side: F.struct(k1.alias("k1"), i1.alias("i1"), k2.alias("k2"), i2.alias("i2"), side.alias("side"))
    k, i = F.col("k"), F.col("i")
    both = F.lit(2)
    same = F.transform(seq("own"), lambda j: F.when(j == i, pair(k, i, k, i, both)).when(j > i, pair(k, i, k, j, F.lit(0))).otherwise(pair(k, j, k, i, F.lit(1))))
    above = F.transform(seq("up"), lambda j: pair(k, i, k + 1, j, F.lit(0)))
    below = F.transform(seq("down"), lambda j: pair(k - 1, j, k, i, F.lit(1)))
    return m.select("of", "node", "root", "copies", F.explode(F.concat(same, above, below)).alias("p")).select("of", "node", "root", "copies", "p.*")


def _compare(rows: DataFrame, width: int, threshold: float, tolerance: float) -> DataFrame:
    """DataFrame[kind, a, b]: for kind 0 node a gets b links; kind 1 is an edge
    of a spanning forest of the similar pairs of one pair of blocks."""

    def group(members):
        by_node = {}
        for node, copies, side, text_shingles in members:
            by_node.setdefault((node, side), (copies, text_shingles))
        keys = list(by_node)
        if len(keys) < 2:
            return []
        sets = [by_node[k][1] for k in keys]
        copies = np.array([by_node[k][0] for k in keys])
        side = np.array([k[1] for k in keys])
        if (side == 2).all():
            left = right = np.arange(len(keys))
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                return []
        i, j = similar_pairs(sets, left, right, threshold, tolerance)
        degree = np.zeros(len(keys), np.int64)
        np.add.at(degree, i, copies[j])
        np.add.at(degree, j, copies[i])
        parent = list(range(len(keys)))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = [(0, keys[x][0], int(degree[x])) for x in np.flatnonzero(degree)]
        for x, y in zip(i.tolist(), j.tolist()):
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                out.append((1, keys[x][0], keys[y][0]))
        return out

    def run(batches):
        keep_only("jaccard_join")
        hashes = _WordHashes()
        current, members = None, []

        def done(out):
            c = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64())], names=["kind", "a", "b"])

        out = []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512).to_pydict()
                for *pair, node, copies, side, text in zip(*(part[c] for c in ("root", "k1", "i1", "k2", "i2", "node", "copies", "side", "text"))):
                    if pair != current:
                        out += group(members)
                        current, members = pair, []
                        if len(out) > 10_000:
                            yield done(out)
                            out = []
                    sh = shingles(text, hashes, width)
                    if len(sh) and set_id(sh) == node:  # else a text with the same hash
                        members.append((node, copies, side, sh))
        out += group(members)
        yield done(out)
        hashes.clear()
        trim()

    cols = ["root", "k1", "i1", "k2", "i2"]
    dealt = rows.repartition(*cols).sortWithinPartitions(*cols)
    return dealt.mapInArrow(run, "kind int, a long, b long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """DataFrame[key, tkey, class_id, n_links, root, empty], one row per row.

    n_links counts the other documents at or above the threshold, class_id is the
    smallest key of the connected component, root an id of the component itself,
    and tkey is xxhash64 of the text.
    """
    plain = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tkey"), F.col(text).alias("text"))
    sets = materialise(_sets(plain, width), "near-sets")
    nodes = materialise(sets.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.min(F.struct("key", "tkey")).alias("of"), F.count("*").alias("copies"), F.first("n").alias("n")), "near-nodes")
    bands = sets.where("node is not null").select("node", F.explode("bands").alias("band"))
    ends = bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("band", "low")
    edges = bands.join(ends, "band").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    roots = components(edges)
    # A node reads its text from one row: by key and text hash, so neither keys that
    # are null nor keys that repeat bring other rows.
    members = _members(plain, nodes, roots)
    rows = members.join(plain, members["of.key"].eqNullSafe(plain["key"]) & (members["of.tkey"] == plain["tkey"])).select(members["*"], "text").drop("of")
    found = materialise(_compare(rows, width, threshold, tolerance), "near-links")
    degree = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("degree"))
    root = components(found.where("kind = 1").select("a", "b"))
    info = nodes.join(degree, "node", "left").join(root, "node", "left").select("node", "key", "copies", F.coalesce("root", "node").alias("root"), (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    names = info.groupBy("root").agg(F.min("key").alias("class_id"))
    info = info.join(names, "root").select("node", "class_id", "n_links", "root")
    out = sets.select("key", "tkey", "node").join(info, "node", "left")
    alone = F.col("node").isNull()
    return out.select(F.col("key").alias(key), "tkey", F.when(alone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root", alone.alias("empty"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each class left: that with the
    smallest key, of equal keys that with the smallest text hash, of equal texts
    any one. Documents without words are classes of their own and stay."""
    work, names, (k, t) = renamed(docs, key, text)
    found = classes(work, k, t)
    first = found.where("not empty").groupBy("root").agg(F.min(F.struct(F.col(k).alias("k"), "tkey")).alias("r")).select("r.k", "r.tkey")
    some = F.coalesce(F.col(t).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    words = work.where(some).withColumn("__t", F.xxhash64(t))
    kept = words.join(first, words[k].cast("long").eqNullSafe(first["k"]) & (words["__t"] == first["tkey"]), "left_semi")
    kept = kept.dropDuplicates([k, "__t"]).drop("__t")
    return kept.unionAll(work.where(~some)).toDF(*names)

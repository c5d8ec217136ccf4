"""Benchmark decontamination by latent semantic retrieval.

The words of the benchmark items are the vocabulary; documents are read in
passages of 64 words, one every 32, and items longer than that in such pieces as
well. One pass replaces every text by the vocabulary numbers of its words, a table
that the three other passes read; none of them shuffles documents:

1. document frequencies of the vocabulary over all documents give TF-IDF weights;
   words of more than ``common`` of the documents only count for items that have
   few rarer ones;
2. a randomised SVD of the passage-by-term matrix A: every task multiplies its
   passages with a fixed random matrix W and adds up its share of A'AW; from
   the sum the leading right singular vectors follow on the driver (Nystroem
   form), whose size depends on the vocabulary alone;
3. every passage is compared with every item by the cosine of their latent
   vectors, to which the part outside the latent space counts with weight
   ``residual``, so items too rare to shape the space are found as well. A piece
   is also a candidate where a passage holds ``HELD`` of the squared weight of its
   own terms (all its words, if few are rare), whatever else the passage holds:
   of a verbatim piece one of two adjacent passages holds half. Candidates are
   checked on words: the longest common subsequence with the item must cover
   ``lcs`` of it, and its answer, the last sentence, ``answer``.

The benchmark is a stated query set. One fit and one scan take all its items; only
a benchmark of more than ``MAX_WORDS`` words, the bound of what is broadcast, is
dealt to parts by a hash of the item, each with its own fit and scan.

Defined results: null and empty texts match nothing, items without words are
never found, items of a single word are found wherever it stands; equal items are
found alike, repeated rows give repeated results; ``scan`` keeps other columns,
whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.sums import SCHEMA, blocks, sum_vectors
from packloom.runtime import keep_only, materialise, prepare, renamed, trim

PASSAGE, STRIDE = 64, 32
RANK = 48
MAX_WORDS = 2_000_000
COMMON = 0.02
LEAST_TERMS = 8
COSINE = 0.3
HELD = 0.35
RESIDUAL = 0.5
LCS = 0.7
ANSWER = 0.6
_WORD = re.compile(r"\w+")
HITS = "array<struct<item_id:bigint,cosine:double,lcs:double,answer:double,first_word:bigint>>"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def answer_of(text: str) -> list[str]:
    """Words of the last sentence; of the last third where that is shorter."""
    parts = [words_of(s) for s in re.split(r"[.!?\n]+", text)]
    parts = [p for p in parts if p]
    last, third = (parts[-1] if parts else []), words_of(text)
    third = third[-(-len(third) // 3) :] if third else []
    return max(last, third, key=len)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of bits per word of b."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = at.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Items:
    """Items, their vocabulary, and (later) weights and latent vectors."""

    ids: list[int]
    #: Vocabulary numbers of the words of items and of their answers.
    words: list[list[int]]
    answers: list[list[int]]
    vocab: dict[str, int]
    idf: np.ndarray | None = None
    used: np.ndarray | None = None
    #: Item and first word of each piece, and the terms by which it is held.
    pieces: list[tuple[int, int]] = field(default_factory=list)
    own: list[np.ndarray] = field(default_factory=list)
    basis: np.ndarray | None = None

    def piece(self, j: int) -> np.ndarray:
        """Vocabulary ids of the words of a piece."""
        i, at = self.pieces[j]
        return np.array(self.words[i][at : at + PASSAGE])


@dataclass
class Texts:
    """Texts as vocabulary numbers, -1 for other words, one after the other."""

    flat: np.ndarray
    ends: np.ndarray  # where each text begins, and the end of the last

    def __len__(self) -> int:
        return len(self.ends) - 1

    def known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place and number of each word of the vocabulary."""
        pos = np.flatnonzero(self.flat >= 0)
        doc = np.searchsorted(self.ends, pos, "right") - 1
        return doc, pos - self.ends[doc], self.flat[pos].astype(np.int64)


def _entries(texts: Texts, n: int, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of ``mask`` in all passages: passage, term and number, sorted by
    passage and term, and the first passage of each text."""
    doc, at, term = texts.known()
    ok = mask[term]
    doc, at, term = doc[ok], at[ok], term[ok]
    starts = np.concatenate([[0], np.cumsum(np.diff(texts.ends) // STRIDE + 2)])[:-1]
    first = starts[doc] + at // STRIDE  # a word is in this passage and the next
    key, tf = np.unique(np.concatenate([first * n + term, (first + 1) * n + term]), return_counts=True)
    return key // n, key % n, tf, starts


def _place(passage: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document of each passage and its number there."""
    doc = np.searchsorted(starts, passage, "right") - 1
    return doc, passage - starts[doc] - 1


def _unit(row: np.ndarray, term: np.ndarray, tf: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows of the passages: entries (row, term, value) sorted by row
    and term, and of each row the passage."""
    none = np.zeros(0, np.int64)
    if not len(row):
        return none, none, np.zeros(0, np.float32), none
    first = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
    size = np.diff(np.append(first, len(row)))
    val = (1 + np.log(tf)) * items.idf[term]
    val = val / np.repeat(np.sqrt(np.add.reduceat(val * val, first)), size)
    return np.repeat(np.arange(len(first)), size), term, val.astype(np.float32), row[first]


def _times(row: np.ndarray, term: np.ndarray, val: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The sparse rows times a matrix."""
    first = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
    out = np.empty((len(first), m.shape[1]), np.float32)
    ends = np.append(first[1:], len(row))
    step = 4096
    for i in range(0, len(first), step):
        a, b = first[i], ends[min(i + step, len(first)) - 1]
        out[i : i + step] = np.add.reduceat(val[a:b, None] * m[term[a:b]], first[i : i + step] - a)
    return out


def load_items(benchmark: list[tuple[int, str | None]]) -> Items:
    rows = [(i, t, words_of(t)) for i, t in benchmark]
    rows = [r for r in rows if r[2]]
    vocab: dict[str, int] = {}
    for _, _, ws in rows:
        for w in ws:
            vocab.setdefault(w, len(vocab))
    numbers = lambda ws: [vocab[w] for w in ws]
    pieces = [(i, at) for i, r in enumerate(rows) for at in range(0, max(len(r[2]) - STRIDE, 1), STRIDE)]
    return Items([r[0] for r in rows], [numbers(r[2]) for r in rows], [numbers(answer_of(r[1])) for r in rows], vocab, pieces=pieces)


def numbered(df: DataFrame, text: str, items: Items, carry: list[str]) -> DataFrame:
    """``carry`` columns and ``__ids``: the vocabulary numbers of each text's words."""
    sent = df.sparkSession.sparkContext.broadcast(items.vocab)
    rows = df.select(*carry, F.col(text).alias("__text"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches):
        keep_only("lsa_decontamination")
        get = sent.value.get
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                flat, ends = [], [0]
                for t in part.column(part.num_columns - 1).to_pylist():
                    flat += [get(w, -1) for w in words_of(t)]
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*carry, "__ids"])
        trim()

    prepare(df.sparkSession)
    return rows.mapInArrow(run, f"{schema}__ids array<int>")


def _texts(batches, column: int):
    """Up to 256 rows at a time, with their texts."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            ids = part.column(column)
            ends = ids.offsets.to_numpy().astype(np.int64)
            yield part, Texts(ids.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0])


def fit(texts: DataFrame, items: Items, common: float = COMMON, rank: int = RANK) -> Items:
    """Passes 1 and 2 over ``texts``, a DataFrame of one column of numbers."""
    n = len(items.vocab)
    prepare(texts.sparkSession)
    sc = texts.sparkSession.sparkContext

    def count(batches):
        total, docs = np.zeros(n), 0
        for _, t in _texts(batches, 0):
            doc, _, term = t.known()
            total += np.bincount(np.unique(doc * n + term) % n, minlength=n)
            docs += len(t)
        yield blocks(np.append(total, docs))

    sums = sum_vectors(texts.mapInArrow(count, SCHEMA))
    df, docs = (sums[:-1], sums[-1]) if len(sums) else (np.zeros(n), 0.0)
    items.idf = np.log((docs + 1) / (df + 0.5)).clip(0.01)
    rare = df <= max(5.0, common * docs)
    items.used = rare.copy()
    items.own = []
    for j in range(len(items.pieces)):
        ids = np.unique(items.piece(j))
        few = rare[ids].sum() < LEAST_TERMS
        items.own.append(ids if few else ids[rare[ids]])
        if few:
            items.used[ids[np.argsort(df[ids], kind="stable")[:LEAST_TERMS]]] = True
    rank = min(rank, n)
    sketch = np.random.default_rng(3).normal(size=(n, rank)).astype(np.float32)
    sent2 = sc.broadcast((items, sketch))

    def gram(batches):
        it, w = sent2.value
        total = np.zeros((n, rank))
        for _, t in _texts(batches, 0):
            *entries, _ = _entries(t, n, it.used)
            row, term, val, passage = _unit(*entries, it)
            if len(passage):
                y = _times(row, term, val, w)
                order = np.argsort(term, kind="stable")
                by = term[order]
                first = np.concatenate([[0], np.flatnonzero(by[1:] != by[:-1]) + 1])
                ends = np.append(first[1:], len(by))
                for i in range(0, len(first), 512):
                    a, b = first[i], ends[min(i + 512, len(first)) - 1]
                    o = order[a:b]
                    total[by[first[i : i + 512]]] += np.add.reduceat(val[o, None] * y[row[o]], first[i : i + 512] - a)
        yield blocks(total)

    g = sum_vectors(texts.mapInArrow(gram, SCHEMA))
    g = g.reshape(n, rank) if len(g) else np.zeros((n, rank))
    c = sketch.T @ g
    shift = 1e-9 * max(np.trace(c), 1e-12)
    g, c = g + shift * sketch, (c + c.T) / 2 + shift * (sketch.T @ sketch)
    values, vectors = np.linalg.eigh(c)
    ok = values > values.max() * 1e-10
    u, s, _ = np.linalg.svd(g @ (vectors[:, ok] / np.sqrt(values[ok])), full_matrices=False)
    items.basis = u[:, s > s[0] * 1e-6].astype(np.float32) if len(s) and s[0] > 0 else np.zeros((n, 1), np.float32)
    return items


class Postings:
    """Of each term the pieces that have it, with a weight."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray], n: int):
        term = np.concatenate([np.zeros(0, np.int64), *terms])
        order = np.argsort(term, kind="stable")
        self.at = np.searchsorted(term[order], np.arange(n + 1))
        self.piece = np.repeat(np.arange(len(terms)), [len(t) for t in terms])[order]
        self.weight = np.concatenate([np.zeros(0), *weights])[order]

    def expand(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a list of terms: which of them each posting answers, and its index."""
        n = self.at[term + 1] - self.at[term]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return np.repeat(np.arange(len(term)), n), np.arange(total) + np.repeat(self.at[term] - ends + n, n)


class Matcher:
    def __init__(self, items: Items, cosine: float, residual: float, lcs: float, answer: float):
        self.items, self.cosine, self.residual, self.lcs, self.answer = items, cosine, residual, lcs, answer
        n = len(items.idf)
        unit, unit_terms, share = [], [], []
        for j, own in enumerate(items.own):
            ids, tf = np.unique(items.piece(j), return_counts=True)
            w = (1 + np.log(tf)) * items.idf[ids]
            used = w[items.used[ids]]
            unit_terms.append(ids[items.used[ids]])
            unit.append(used / max(np.sqrt((used**2).sum()), 1e-9))
            w = w[np.isin(ids, own)] ** 2
            share.append(w / w.sum())
        self.unit, self.share = Postings(unit_terms, unit, n), Postings(items.own, share, n)
        self.terms = items.used | (np.diff(self.share.at) > 0)
        self.latent = np.stack([w.astype(np.float32) @ items.basis[t] if len(t) else np.zeros(items.basis.shape[1], np.float32) for t, w in zip(unit_terms, unit)])
        self.norm = np.sqrt((1 - residual) * (self.latent**2).sum(1) + residual)

    def _chunks(self, row: np.ndarray):
        """Entries of so many rows at a time that rows times pieces are a million."""
        step = max(1, 1_000_000 // len(self.items.pieces))
        cuts = np.searchsorted(row, np.arange(0, row[-1] + step + 1, step)) if len(row) else []
        for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                yield c * step, int(a), int(b)

    def near(self, row, term, val) -> tuple[np.ndarray, np.ndarray]:
        """Rows times pieces + piece where the cosine is high enough, and the cosine."""
        k = len(self.items.pieces)
        keys, cosines = [np.zeros(0, np.int64)], [np.zeros(0)]
        for base, a, b in self._chunks(row):
            r, t, v = row[a:b] - base, term[a:b], val[a:b]
            rows = int(r[-1]) + 1
            z = _times(r, t, v, self.items.basis)
            which, at = self.unit.expand(t)
            plain = np.bincount(r[which] * k + self.unit.piece[at], v[which] * self.unit.weight[at], rows * k).reshape(rows, k)
            norm = np.sqrt((1 - self.residual) * (z**2).sum(1) + self.residual)
            s = ((1 - self.residual) * (z @ self.latent.T) + self.residual * plain) / (norm[:, None] * self.norm)
            x, j = np.nonzero(s >= self.cosine)
            keys.append((x + base) * k + j)
            cosines.append(s[x, j])
        return np.concatenate(keys), np.concatenate(cosines)

    def held(self, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages times pieces + piece, where the passage holds enough of it."""
        k = len(self.items.pieces)
        out = [np.zeros(0, np.int64)]
        for base, a, b in self._chunks(row):
            which, at = self.share.expand(term[a:b])
            if len(at):
                share = np.bincount((row[a:b][which] - base) * k + self.share.piece[at], self.share.weight[at])
                out.append(np.flatnonzero(share >= HELD) + base * k)
        return np.concatenate(out)

    def match(self, texts: Texts) -> list[list[dict]]:
        """The leaks of each text, by item."""
        best: list[dict[int, tuple]] = [{} for _ in range(len(texts))]
        k = len(self.items.pieces)
        row, term, tf, starts = _entries(texts, len(self.items.idf), self.terms)
        ok = self.items.used[term]
        *entries, passage = _unit(row[ok], term[ok], tf[ok], self.items)
        near, cosines = self.near(*entries)
        near = passage[near // k] * k + near % k if len(near) else near
        key = np.union1d(near, self.held(row, term)).astype(np.int64)
        cosine = np.zeros(len(key))
        cosine[np.searchsorted(key, near)] = cosines
        doc, number = _place(key // k, starts)
        done: set[tuple[int, int, int]] = set()
        # The best passage first, so that of a long item's pieces, which all tell
        # of one place, one check is made.
        for x in np.argsort(-cosine, kind="stable").tolist():
            d, at = int(doc[x]), int(number[x]) * STRIDE
            i, off = self.items.pieces[int(key[x] % k)]
            item = self.items.words[i]
            if len(item) > PASSAGE:
                place = (d, i, (at - off) // STRIDE)
                if place in done:
                    continue
                done.add(place)
            lo = max(0, at - len(item))
            text = texts.flat[texts.ends[d] : texts.ends[d + 1]]
            region = text[lo : max(0, at + PASSAGE + len(item))].tolist()
            share = common_subsequence(item, region) / len(item)
            if share < self.lcs:
                continue
            ans = self.items.answers[i]
            told = common_subsequence(ans, region) / len(ans)
            if told >= self.answer:
                found = (share, told, float(cosine[x]), -max(0, at))
                if found > best[d].get(i, (0,)):
                    best[d][i] = found
        return [[{"item_id": self.items.ids[i], "cosine": f[2], "lcs": f[0], "answer": f[1], "first_word": -f[3]} for i, f in sorted(b.items())] for b in best]


def _scan(docs: DataFrame, benchmark: DataFrame, text: str, carry: list[str], item_id: str = "item_id", item_text: str = "text", cosine: float = COSINE, residual: float = RESIDUAL, lcs: float = LCS, answer: float = ANSWER, max_words: int = MAX_WORDS) -> DataFrame:
    """``carry`` columns and ``__leaks``; ``docs`` has the names of ``renamed``."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    words = rows.agg(F.sum(F.regexp_count(F.coalesce("t", F.lit("")), F.lit(r"(?U)\w+")))).first()[0] or 0
    parts = 1 if words <= max_words else -(-3 * words // (2 * max_words))
    out = docs.select(*dict.fromkeys([*carry, text]), F.array().cast(HITS).alias("__leaks"))
    for p in range(parts):
        mine = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p)
        items = load_items(sorted(((r.i, r.t) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))
        if items.ids:
            kept = [*dict.fromkeys([*carry, *([text] if p + 1 < parts else [])]), "__leaks"]
            whole = materialise(numbered(out, text, items, kept), "lsa-numbers")
            out = _match(whole, fit(whole.select("__ids"), items), cosine, residual, lcs, answer)
    return out.select(*carry, "__leaks")


def _match(df: DataFrame, items: Items, *limits: float) -> DataFrame:
    """``df`` with the new leaks after the old ones, and without its numbers."""
    sent = df.sparkSession.sparkContext.broadcast((items, limits))
    names = df.columns[:-1]
    last = len(names) - 1
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("first_word", pa.int64())]))

    def run(batches):
        keep_only("lsa_decontamination")
        it, lim = sent.value
        matcher = Matcher(it, *lim)
        for part, texts in _texts(batches, last + 1):
            new = [a + b for a, b in zip(part.column(last).to_pylist(), matcher.match(texts))]
            yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(new, kind)], names=names)
        trim()

    return df.mapInArrow(run, df.drop("__ids").schema)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", name: str = "leaks", **limits) -> DataFrame:
    """``docs`` with a column ``name``: the items that each text leaks."""
    work, names, (t,) = renamed(docs, text)
    return _scan(work, benchmark, t, work.columns, **limits).toDF(*names, name)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """DataFrame[key, item_id, cosine, lcs, answer, first_word]: a row for each
    item that a document leaks."""
    work, _, (k, t) = renamed(docs, key, text)
    found = _scan(work, benchmark, t, [k], **limits)
    return found.select(k, F.explode("__leaks").alias("l")).select(F.col(k).alias(key), "l.*")


def remove_leaking(docs: DataFrame, benchmark: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    work, names, (t,) = renamed(docs, text)
    return _scan(work, benchmark, t, work.columns, **limits).where(F.size("__leaks") == 0).drop("__leaks").toDF(*names)

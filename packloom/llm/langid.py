"""Language identification of code-switched text by a linear-chain CRF.

Every word of letters is a position of the chain and its label a language.
Features of a word are its lower-cased form (lexicon), its prefixes and suffixes
of 1 to 3 letters, its inner 2- and 3-grams, and a bias; they are hashed to a
fixed number of weights. Transitions between labels are learned. Forward-backward
gives the label distribution of each word; a document's language is the one with
the largest sum of word probabilities, weighted by word length, and its score is
that sum's share.

Training reads a bounded sample of labelled rows: the ``sample`` different rows of
each language with the smallest hash of key and text. Sequences for training are spliced
from pieces of rows of several languages, so that transitions are seen.

Defined results: a text that is null or has no letter gets ``und`` and score 0;
equal texts get equal predictions; rows without a label are never learned from;
rows with the same key, text and label are learned once, and keys may be null or
all alike; if there is no labelled row every text gets ``und`` and score 0; extra
columns of any name are kept or ignored as asked.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.runtime import keep_only, prepare, renamed, trim

SAMPLE = 300
BUCKETS = 1 << 16
WIDTH = 24
UND = "und"
_WORDS = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 200_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature indices, int32[m, k], BUCKETS is no feature, and the number
    of the word that each row belongs to.

    A word longer than WIDTH has several rows, which overlap by two letters: the
    first has the affixes and the lexicon feature, all have n-grams, each once.
    """
    many = [[w] if len(w) <= WIDTH else [w[i : i + WIDTH] for i in range(0, len(w) - 2, WIDTH - 2)] for w in words]
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, many), np.int64, len(words)))
    cut = [c for cs in many for c in cs]
    n = len(cut)
    head = np.concatenate([[True], owner[1:] != owner[:-1]]) if n else np.zeros(0, bool)
    size = np.fromiter(map(len, cut), np.int64, n)
    at = np.concatenate([[0], np.cumsum(size)])
    chars = np.frombuffer("".join(cut).encode("utf-32-le"), np.uint32).astype(np.uint64)
    x = np.zeros((n, WIDTH), np.uint64)
    row = np.repeat(np.arange(n), size)
    col = np.arange(len(chars)) - at[row]
    x[row, col] = chars
    with np.errstate(over="ignore"):
        m1, m2, m3 = np.uint64(0x100000001B3), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        out = []

        def put(value, kind, ok):
            h = _mix(value * m1 + np.uint64(kind) * m2)
            out.append(np.where(ok, h % np.uint64(BUCKETS), np.uint64(BUCKETS)))

        last = np.take_along_axis(x, np.stack([np.maximum(size - 1, 0), np.maximum(size - 2, 0), np.maximum(size - 3, 0)], 1), 1)
        for r in np.flatnonzero(head[:-1] & ~head[1:]).tolist():
            last[r] = [ord(c) for c in words[owner[r]][:-4:-1]]
        pre, suf = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(3):
            pre, suf = pre * m3 + x[:, k], suf * m3 + last[:, k]
            put(pre, 1 + k, head & (size > k))
            put(suf, 4 + k, head & (size > k))
        whole = np.fromiter((hash_word(w) for w in words), np.uint64, len(words))[owner]
        put(whole, 7, head)
        bi = x[:, :-1] * m3 + x[:, 1:]
        for j in range(WIDTH - 1):
            ok = size > j + 1
            if not ok.any():
                break
            put(bi[:, j], 8, ok if j else ok & head)
            if j + 2 < WIDTH:
                put(bi[:, j] * m3 + x[:, j + 2], 9, size > j + 2)
    return np.stack(out, 1).astype(np.int32), owner


def hash_word(w: str) -> int:
    """The same in every process, unlike hash()."""
    b = w.encode("utf-8")
    return zlib.crc32(b) | zlib.adler32(b) << 32


class Model:
    """Emission weights [BUCKETS + 1, L], the last row zero, and transitions [L, L]."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.emit = np.zeros((BUCKETS + 1, n), np.float32)
        self.bias = np.zeros(n, np.float32)
        self.trans = np.zeros((n, n), np.float32)

    def emissions(self, feats: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Scores of words, the sums of their rows; ``owner`` rises and has no gap."""
        out = np.empty((len(feats), len(self.labels)), np.float32)
        for i in range(0, len(feats), 8192):
            out[i : i + 8192] = self.emit[feats[i : i + 8192]].sum(1)
        if len(owner) and owner[-1] + 1 < len(owner):
            out = np.add.reduceat(out, np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])))
        return out + self.bias


def forward_backward(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals [B, T, L], summed pair marginals [L, L], log-likelihood part [B]
    (the log partition) of a batch of emission scores padded to T, for sequences
    ordered by falling length."""
    b, t, n = e.shape
    top = e.max(2, keepdims=True)
    p = np.exp(e - top)
    m = np.exp(trans)
    active = np.array([int(np.searchsorted(-lengths, -i, "left")) for i in range(t)])  # sequences longer than i
    f, back = np.zeros_like(p), np.ones_like(p)
    scale = np.ones((b, t), p.dtype)
    cur = p[:, 0]
    scale[:, 0] = cur.sum(1)
    f[:, 0] = cur / scale[:, :1]
    for i in range(1, t):
        k = active[i]
        cur = (f[:k, i - 1] @ m) * p[:k, i]
        s = cur.sum(1)
        scale[:k, i] = s
        f[:k, i] = cur / s[:, None]
    pairs = np.zeros((n, n))
    for i in range(t - 2, -1, -1):
        k = active[i + 1]
        if k:
            nxt = p[:k, i + 1] * back[:k, i + 1] / scale[:k, i + 1 : i + 2]
            back[:k, i] = nxt @ m.T
            pairs += (f[:k, i].T @ nxt) * m
    g = f * back
    mask = np.arange(t)[None] < lengths[:, None]
    logz = (np.log(scale) * mask).sum(1) + (top[:, :, 0] * mask).sum(1)
    return g * mask[:, :, None], pairs, logz


def _splice(rows: list[tuple[str, str]], labels: list[str], rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Sequences of 40 words or so: most stay in one language, the others change
    it every few words."""
    by = {k: [w for text, lang in rows if lang == lab for w in _WORDS.findall(text.lower())] for k, lab in enumerate(labels)}
    by = {k: v for k, v in by.items() if v}
    at = dict.fromkeys(by, 0)
    out = []
    keys = list(by)
    total = sum(map(len, by.values()))
    while sum(at.values()) < total:
        words, tags = [], []
        mixed = rng.random() < 0.5
        left = [k for k in keys if at[k] < len(by[k])]
        k = int(rng.choice(left))
        while len(words) < 40 and left:
            n = int(rng.integers(4, 14)) if mixed else 40
            piece = by[k][at[k] : at[k] + n]
            at[k] += n
            words += piece
            tags += [k] * len(piece)
            left = [j for j in keys if at[j] < len(by[j])]
            if left:
                k = int(rng.choice(left))
        at = {j: min(v, len(by[j])) for j, v in at.items()}
        if words:
            out.append((words, tags))
    return out


def train(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 0.2, seed: int = 7) -> Model:
    """Fit by AdaGrad on the CRF's log-likelihood."""
    labels = sorted({lang for _, lang in rows})
    model = Model(labels)
    rng = np.random.default_rng(seed)
    seqs = _splice(rows, labels, rng)
    vocab: dict[str, int] = {}
    for words, _ in seqs:
        for w in words:
            vocab.setdefault(w, len(vocab))
    feats, owner = word_features(list(vocab)) if vocab else (np.zeros((0, 1), np.int32), np.zeros(0, np.int64))
    n = len(labels)
    g_emit, g_bias, g_trans = np.full_like(model.emit, 1e-2), np.full(n, 1e-2), np.full((n, n), 1e-2)
    size = 64
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        for start in range(0, len(order), size):
            part = sorted((seqs[i] for i in order[start : start + size]), key=lambda s: -len(s[0]))
            lengths = np.array([len(w) for w, _ in part])
            t = int(lengths.max())
            ids = np.zeros((len(part), t), np.int64)
            tags = np.full((len(part), t), -1)
            for i, (w, y) in enumerate(part):
                ids[i, : len(w)] = [vocab[x] for x in w]
                tags[i, : len(y)] = y
            used, back = np.unique(ids, return_inverse=True)
            seen = np.zeros(len(vocab), bool)
            seen[used] = True
            rows_of = np.flatnonzero(seen[owner])
            own = np.searchsorted(used, owner[rows_of])
            e = model.emissions(feats[rows_of], own)[back.reshape(ids.shape)]
            marg, pairs, _ = forward_backward(e.astype(np.float64), lengths, model.trans.astype(np.float64))
            grad = -marg
            i, j = np.nonzero(tags >= 0)
            grad[i, j, tags[i, j]] += 1.0
            by_word = np.zeros((len(used), n))
            np.add.at(by_word, back.reshape(ids.shape)[i, j], grad[i, j])
            count = np.zeros((n, n))
            pi, pj = np.nonzero(tags[:, 1:] >= 0)
            np.add.at(count, (tags[pi, pj], tags[pi, pj + 1]), 1)
            scale = 1.0 / len(part)
            f = feats[rows_of]
            touched, where = np.unique(f, return_inverse=True)
            ge = np.zeros((len(touched), n))
            np.add.at(ge, where.reshape(f.shape).ravel(), np.repeat(by_word[own], f.shape[1], 0))
            ge *= scale
            ge[touched == BUCKETS] = 0
            g_emit[touched] += ge**2
            model.emit[touched] += rate * ge / np.sqrt(g_emit[touched])
            gb = by_word.sum(0) * scale
            g_bias += gb**2
            model.bias += rate * gb / np.sqrt(g_bias)
            gt = (count - pairs) * scale
            g_trans += gt**2
            model.trans += rate * gt / np.sqrt(g_trans)
    model.emit *= 0.5  # tempered: training words are known better than others
    return model


def _words(text: str | None) -> list[str]:
    """The words of a text, none if it has no letter."""
    words = _WORDS.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


class Tagger:
    """Labels texts; emission scores of words seen before are kept in a table of
    bounded size."""

    def __init__(self, model: Model):
        self.model = model
        self.words: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.labels)), np.float32)

    def _ids(self, docs: list[list[str]]) -> list[np.ndarray]:
        known = self.words
        new = [w for w in {w for d in docs for w in d} if w not in known]
        if len(known) + len(new) > CACHED_WORDS:
            known = self.words = {}
            self.rows = self.rows[:0]
            new = list({w for d in docs for w in d})
        if new:
            n = len(known)
            known.update(zip(new, range(n, n + len(new))))
            self.rows = np.concatenate([self.rows, *(self.model.emissions(*word_features(new[i : i + 20_000])) for i in range(0, len(new), 20_000))])
        look = known.__getitem__
        return [np.fromiter(map(look, d), np.int64, len(d)) for d in docs]

    def tag(self, texts: list[str | None]) -> list[tuple[str, float, np.ndarray]]:
        """(language, score, label of each word) of each text."""
        docs = [_words(t) for t in texts]
        out: list = [(UND, 0.0, np.zeros(0, np.int64))] * len(docs)
        if not self.model.labels:
            return out
        ids = self._ids(docs)
        order = sorted((i for i in range(len(docs)) if docs[i]), key=lambda i: -len(docs[i]))
        at = 0
        while at < len(order):
            longest = len(docs[order[at]])
            part = order[at : at + max(1, min(256, 200_000 // longest))]
            at += len(part)
            lengths = np.array([len(docs[i]) for i in part])
            e = np.zeros((len(part), longest, len(self.model.labels)), np.float32)
            for r, i in enumerate(part):
                e[r, : lengths[r]] = self.rows[ids[i]]
            marg, _, _ = forward_backward(e, lengths, self.model.trans)
            for r, i in enumerate(part):
                m = marg[r, : lengths[r]]
                weight = np.fromiter(map(len, docs[i]), np.float32, lengths[r])
                share = weight @ m
                share = share / share.sum()
                k = int(share.argmax())
                out[i] = (self.model.labels[k], float(min(1.0, share[k])), m.argmax(1))
        return out


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", where: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows of each language, those with the
    smallest hashes of key and text, each whole, as its words.

    The numbers of different rows by language give a hash bound below which about
    twice the sample lies, so one further pass brings a bounded number of rows to
    the driver, repeated ones once.
    """
    rows = df if where is None else df.where(where)
    rows = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.xxhash64(key, text).alias("h"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return Model([])
    low, span = -(1 << 63), 1 << 64
    bound = F.lit(None).cast("long")
    for lab, n in sorted(counts.items()):
        share = min(1.0, (2 * sample + 50) / max(1, n))
        bound = F.when(F.col("l") == lab, F.lit(min((1 << 63) - 1, low + int(share * span)))).otherwise(bound)

    def words(batches):
        keep_only("language_crf")
        for b in batches:
            t = [" ".join(_words(x)) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t, pa.string())], names=["h", "l", "t"])

    prepare(df.sparkSession)
    # Repeated rows are one before they are sent, however many there are.
    got = rows.where(F.col("h") <= bound).mapInArrow(words, "h long, l string, t string").groupBy("h", "l").agg(F.min("t").alias("t")).collect()
    by: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r.h, r.l)):
        by.setdefault(r.l, []).append((r.t, r.l))
    return train([x for lab in sorted(by) for x in by[lab][:sample]])


def predict(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` after them."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    work, names, (t,) = renamed(df, text)
    kept = [f"__c{names.index(c)}" for c in keep]
    work = work.select(*kept, F.col(t).alias("__text"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in work.schema.fields[:-1])

    def run(batches):
        keep_only("language_crf")
        tagger = Tagger(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                got = tagger.tag(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*kept, "lang_pred", "score"])
        del tagger
        trim()

    prepare(df.sparkSession)
    return work.mapInArrow(run, f"{schema}lang_pred string, score double").toDF(*keep, "lang_pred", "score")


def spread(key: str, mod: int) -> Column:
    """crc32 of a key as text, mod ``mod``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod

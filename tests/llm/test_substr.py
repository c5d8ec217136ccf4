import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from packloom.llm import substr, suffix


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for k in range(300):
        d = rng.integers(0, int(rng.choice([1, 2, 3, 256])), int(rng.integers(1, 60))).astype(np.uint8)
        d = np.tile(d, 3) if k % 5 == 0 else d
        b = d.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffix.suffix_array(d)
        assert sa.tolist() == want
        plcp = suffix.permuted_lcp(d, sa)
        for x, y in zip(want, want[1:]):
            n = 0
            while max(x, y) + n < len(b) and b[x + n] == b[y + n]:
                n += 1
            assert plcp[y] == n


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, letters, n):
    rng = random.Random(seed)
    passages = ["".join(rng.choices(letters, k=rng.randint(15, 80))) for _ in range(6)]
    out = [None, "", "short"]
    for _ in range(n):
        parts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(rng.randint(1, 5))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        out.append("".join(parts))
    return out + [out[-1], out[-1], "a" * 300, "ab" * 100 + "é"]


@pytest.mark.parametrize("letters,shard,hot", [("abcdefghijklmnop é", 1 << 20, 16), ("ab", 4000, 16), ("abcdefghijklmnop é", 500, 16), ("abcdefghijklmnop é", 300, 1), ("ab", 900, 1)])
def test_against_brute_force(spark, letters, shard, hot):
    texts = corpus(len(letters) + shard, letters, 60)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_spans int")
    got = {r.doc_id: tuple(r)[1:] for r in substr.remove_repeats(df, length=20, shard_bytes=shard, hot_blocks=hot).collect()}
    for i, want in enumerate(brute(texts, 20)):
        assert got[i] == want, (i, texts[i])


def test_edges(spark):
    df = spark.createDataFrame([(1, "x" * 399), (1, "y" * 400), (2, "y" * 400), (None, "z" * 401), (3, "z" * 400)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_removed, r.n_spans) for r in substr.remove_repeats(df).collect())
    assert got == [(0, 401, 1), (1, 0, 0), (1, 400, 1), (2, 400, 1), (3, 400, 1)]
    assert substr.remove_repeats(df.limit(0)).count() == 0


def test_windows_are_dealt_once():
    data = bytes(random.Random(1).choices(range(256), k=5000))
    seen = [w for _, _, s, n, _ in substr.runs(data, 400) for w in range(s, s + n)]
    assert seen == list(range(5000 - 399))
    moved = {r[:2] for r in substr.runs(b"q" * 77 + data, 400)}
    assert len(moved & {r[:2] for r in substr.runs(data, 400)}) > 10


def test_null_keys_and_clashing_columns(spark):
    texts = corpus(5, "abcdefgh", 12)
    df = spark.createDataFrame([(None, t, "x", 1) for t in texts], "doc_id long, text string, tkey string, `__c1` int")
    got = sorted(tuple(r)[1:] for r in substr.remove_repeats(df, length=20).collect())
    assert got == sorted(brute(texts, 20))

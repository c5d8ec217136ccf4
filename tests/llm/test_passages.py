import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from packloom.llm import lblm, passages, substr

RNG = random.Random(11)


def prose(n):
    return [f"w{RNG.randrange(5000)}" for _ in range(n)]


def brute(rows, length):
    """Words in windows that another (key, text) has too."""
    has = defaultdict(set)
    docs = [(k, t, lblm.tokens(t)) for k, t in rows]
    for k, t, ws in docs:
        for i in range(len(ws) - length + 1):
            has[tuple(ws[i : i + length])].add((k, t))
    out = []
    for k, _, ws in docs:
        hit = {j for i in range(len(ws) - length + 1) if len(has[tuple(ws[i : i + length])]) > 1 for j in range(i, i + length)}
        out.append((k, len(hit)))
    return sorted(out)


def planted():
    """Texts with passages of 40 to 70 words, some in two texts, some twice in one."""
    rows = []
    for _ in range(25):
        p = prose(RNG.randrange(40, 71))
        for _ in range(2):
            rows.append(prose(RNG.randrange(60)) + p + prose(RNG.randrange(60)))
    for _ in range(5):
        p = prose(60)
        rows.append(p + prose(9) + p)
    near = prose(300)
    for i in range(8):
        rows.append([*near[: 30 * i + 20], f"edit{i}", *near[30 * i + 21 :]])
    rows += [prose(200)] * 3 + [prose(20)] * 2 + [["aa"] * 150, ["aa"] * 70 + ["b"], []]
    texts = ["  ".join(w.upper() if RNG.random() < 0.1 else w for w in r) + " \n" * RNG.randrange(2) for r in rows]
    return [*enumerate(texts), (500, None), (501, "é😀 " * 80), (502, "É é😀 " + "é😀\t" * 60)]


def test_shared_words(spark):
    """a passage of over 50 words that repeats is told, however few bytes it has."""
    rows = planted()
    rows += [rows[0], (900, rows[0][1])]  # a row again, and its text under another key
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substr.remove_repeats(df, passage_words=51).collect()
    assert sorted((r.doc_id, r.n_shared_words) for r in got) == brute(rows, 51)
    short = [r for r in got if r.n_shared_words and not r.n_removed]
    assert len(short) > 10  # under 400 bytes: nothing is removed, by contract
    plain = {r for r in substr.remove_repeats(df).collect()}
    assert {tuple(r)[:-1] for r in got} == {tuple(r) for r in plain}
    assert substr.remove_repeats(df.limit(0), passage_words=51).count() == 0


def test_short_passages(spark):
    rows = [(i, " ".join(RNG.choice("abc") for _ in range(RNG.randrange(40)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (7, 20):
        got = substr.remove_repeats(df, passage_words=length).collect()
        assert sorted((r.doc_id, r.n_shared_words) for r in got) == brute(rows, length)


def test_runs_hold_every_window_once(monkeypatch):
    texts = [t for _, t in planted()]
    words, each = lblm.split(pa.array(texts, pa.string()))
    hashes = passages.word_hashes(words)
    assert len(set(hashes.tolist())) == len(set(words.to_pylist()))
    for chunk in (passages._CHUNK, 100):
        monkeypatch.setattr(passages, "_CHUNK", chunk)
        text, anchor, ctx, s, n = passages.runs(hashes, each, 51)
        got = sorted((t, i) for t, a, k in zip(text.tolist(), s.tolist(), n.tolist()) for i in range(a, a + k))
        assert got == [(t, i) for t, k in enumerate(each.tolist()) for i in range(k - 50)]
        assert len(ctx) == len(anchor) == len(n)
    assert [len(x) for x in passages.runs(hashes[:0], each[:0], 51)] == [0] * 5
    assert passages.word_hashes(pa.array([], pa.string())).dtype == np.uint64

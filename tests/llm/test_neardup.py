import random
from collections import defaultdict

import numpy as np

from packloom.llm import graph, neardup


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (20, 20)] + [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(300, 400)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert (got[3], got[12], got[180], got[399], got[500]) == (1, 10, 100, 300, 300) and 20 not in got
    assert len(got) == 3 + 3 + 81 + 101
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows):
    def sh(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [sh(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], k)
    return [(rows[i][0], least[find(i)], links[i]) for i in range(len(rows))]


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            t = rng.choice(out).split()
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
        else:
            out.append(" ".join(rng.choices(words, k=rng.choice([3, 5, 8, 40, 90, 200]))))
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, class_id string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in neardup.classes(df, **kw).collect())
    assert got == sorted(brute(rows))
    return df


def test_against_brute_force(spark, monkeypatch):
    rows = [(1000 - i, t) for i, t in enumerate(corpus(3, 220) + ["", None, " \n", "One", "one", "Long " * 30_000])]
    df = check(spark, rows)
    kept = sorted(r.doc_id for r in neardup.keep_one(df).collect())
    assert kept == sorted({c for _, c, _ in brute(rows)})
    monkeypatch.setattr(neardup, "BLOCK", 16)  # components cut into blocks
    check(spark, rows)


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f")] * 3 + [(1, "z y x w v u")]
    df = check(spark, rows)
    assert neardup.keep_one(df).count() == 2
    assert neardup.classes(df.limit(0)).count() == 0 and neardup.keep_one(df.limit(0)).count() == 0


def test_pruning_keeps_what_may_pass():
    least = neardup.least_matches(0.8, 1e-6, 96, 16)
    assert least == sorted(least) and 0 < least[0] < 8 and least[-1] < 0.8 * 96
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 62, 400, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[: 400 - k], rng.integers(0, 1 << 62, k, dtype=np.uint64)])) for k in range(0, 120, 4)]
    at = np.arange(len(sets))
    i, j = neardup.similar_pairs(sets, at, at, 0.8, 1e-6)
    want = {(x, y) for x in at for y in at if x < y and len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y]))}
    assert set(zip(i.tolist(), j.tolist())) == want

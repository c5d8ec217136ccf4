import random

import numpy as np

from packloom.llm import decontam

RNG = random.Random(4)
COMMON = [f"c{i}" for i in range(30)]
RARE = [f"r{i}" for i in range(4000)]


def prose(n):
    return " ".join(RNG.choice(COMMON) if RNG.random() < 0.5 else RNG.choice(RARE) for _ in range(n))


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence():
    for _ in range(100):
        a, b = [RNG.choices("abc", k=RNG.randint(0, 12)) for _ in range(2)]
        assert decontam.common_subsequence(a, b) == slow_lcs(a, b)


ITEMS = [(i, prose(RNG.randint(15, 59)) + ".") for i in range(40)] + [(90, None), (91, "..."), (92, "")]


def leak(text, i, rate):
    words = [w if RNG.random() > rate else RNG.choice(RARE) for w in ITEMS[i][1].split()]
    parts = text.split()
    at = RNG.randint(0, len(parts))
    return " ".join(parts[:at] + words + parts[at:])


def test_leaks(spark):
    rows, want = [], set()
    for d in range(300):
        t = prose(RNG.choice([10, 100, 600]))
        if d % 5 == 0:
            i = d // 5 % 40
            t = leak(t, i, 0.0 if d % 2 else 0.08)
            want.add((d, i))
        rows.append((d, t.upper() if d % 3 == 0 else t, "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "word " * 50_000 + ITEMS[3][1], "x"), (902, ITEMS[3][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, leaks string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()]
    assert sorted(got) == sorted(want | {(902, 3)}) + [(902, 3)]
    # Brute force: the word check alone, over every item and every passage.
    slow = set()
    for d, t, _ in rows[:120]:
        ws = decontam.words_of(t)
        for i, b in ITEMS[:40]:
            item, ans = decontam.words_of(b), decontam.answer_of(b)
            for at in range(-32, len(ws), 32):
                region = ws[max(0, at - len(item)) : max(0, at + 64 + len(item))]
                if slow_lcs(item, region) >= 0.7 * len(item) and slow_lcs(ans, region) >= 0.6 * len(ans):
                    slow.add((d, i))
                    break
    assert slow == {g for g in got if g[0] < 120}
    kept = decontam.remove_leaking(df, bench)
    assert kept.columns == df.columns and kept.count() == len(rows) - len(want) - 2
    assert decontam.leaks(df.limit(0), bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0


def test_parts_of_a_large_benchmark(spark):
    df = spark.createDataFrame([(1, leak(leak(prose(200), 2, 0), 30, 0)), (2, prose(300))], "doc_id long, text string")
    got = decontam.leaks(df, spark.createDataFrame(ITEMS, "item_id long, text string"), max_words=700).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 2), (1, 30)]


def test_sketch_finds_the_leading_space(spark):
    words = [f"t{i}" for i in range(12)]
    items = decontam.load_items([(1, " ".join(words))])
    texts = [" ".join(RNG.sample(words[:6], 4)) for _ in range(60)] + [" ".join(RNG.sample(words[6:], 4)) for _ in range(30)]
    df = decontam.numbered(spark.createDataFrame([(t,) for t in texts], "text string"), "text", items, [])
    it = decontam.fit(df, items, common=1.0, rank=12)
    ids = [[it.vocab[w] for w in t.split()] for t in texts]
    *entries, _ = decontam._entries(decontam.Texts(np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])), 12, it.used)
    row, term, val, passage = decontam._unit(*entries, it)
    a = np.zeros((len(passage), 12))
    a[row, term] = val
    v = np.linalg.svd(a, full_matrices=False)[2][:4].T
    assert np.linalg.norm(it.basis[:, :4].T @ v, 2) > 0.999 and np.allclose(it.basis.T @ it.basis, np.eye(it.basis.shape[1]), atol=1e-4)


def test_verbatim_leaks_reach_the_word_check(spark):
    rng = random.Random(7)
    hot = " ".join(rng.choice(COMMON) for _ in range(20)) + "."
    long = " ".join(f"l{rng.randrange(900)}" for _ in range(700)) + "."
    short = "s1 c3 s2 s3 c4."
    single = "alone."
    items = [(0, hot), (1, long), (2, short), (3, single)] + [(10 + i, " ".join(rng.choice(RARE) for _ in range(40)) + ".") for i in range(150)]
    rows = []
    for d in range(120):
        words = prose(rng.choice([100, 300])).split()
        at = rng.randint(0, len(words))
        leaked = [[0], [0, 1], [2], [3], [], []][d % 6]
        rows.append((d, " ".join(words[:at] + " ".join(items[i][1] for i in leaked).split() + words[at:]), leaked))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(d, i) for d, _, leaked in rows for i in leaked} <= got
    assert not {g for g in got if g[1] in (1, 2, 3)} - {(d, i) for d, _, leaked in rows for i in leaked}


def test_clashing_columns_and_ties(spark):
    item = "delta omega sigma kappa lambda theta."
    rows = [(None, item, 1, "p"), (None, item, 1, "p"), (2, "nothing here", 2, "q"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __leaks_found int, `__c1.x` string")
    bench = spark.createDataFrame([(7, item, "z"), (7, item, "z")], "item_id long, text string, i string")
    assert sorted(r.item_id for r in decontam.leaks(df, bench).collect()) == [7, 7, 7, 7]
    kept = decontam.remove_leaking(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert decontam.scan(df.toDF("doc_id", "text", "__leaks", "__ids"), bench).columns[-1] == "leaks"

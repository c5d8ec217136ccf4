import itertools
import math
import zlib

import numpy as np

from packloom.llm import langid


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([4, 3, 1])
    e, trans = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3))
    marg, pairs, logz = langid.forward_backward(e, lengths, trans)
    want = np.zeros((3, 3))
    for b, n in enumerate(lengths):
        total, m, pr = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            w = math.exp(sum(e[b, i, y] for i, y in enumerate(path)) + sum(trans[a, c] for a, c in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                m[i, y] += w
            for a, c in zip(path, path[1:]):
                pr[a, c] += w
        assert np.allclose(marg[b, :n], m / total) and np.isclose(logz[b], math.log(total))
        want += pr / total
    assert np.allclose(pairs, want)


ROWS = [("the cat and the house with those things", "en"), ("die katze und das haus mit diesen dingen", "de")]


def test_rows(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(200):
        words = ROWS[i % 2][0].split()
        data.append((i, " ".join(rng.choice(words, 12)), ROWS[i % 2][1], "en"))
    data += [(900, None, "en", ""), (901, "123 ½ --", "de", ""), (902, "the house with things " * 3 + "die katze und diesen", None, ""), (903, "", None, ""), (904, "katze " * 50_000, None, "")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, lang_pred string")
    held = langid.spread("doc_id", 3) == 1
    model = langid.fit(df, where=~held, sample=40)
    got = {r.doc_id: r for r in langid.predict(df, model, ["doc_id"]).collect()}
    assert len(got) == len(data) and model.labels == ["de", "en"]
    for i in range(200):
        if zlib.crc32(str(i).encode()) % 3 == 1:
            assert got[i].lang_pred == data[i][2] and 0.5 < got[i].score <= 1
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 903))
    assert got[902].lang_pred == "en" and got[902].score < 0.9 and got[904].lang_pred == "de"
    none = langid.fit(df.where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.predict(df, none, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(df.limit(0), model, ["doc_id"]).count() == 0


def test_words_change_language():
    rng = np.random.default_rng(2)
    model = langid.train([(" ".join(rng.choice(t.split(), 12)), lab) for t, lab in ROWS * 60])
    (_, _, tags), = langid.Tagger(model).tag(["the house with things die katze und diesen dingen"])
    assert [model.labels[t] for t in tags] == ["en"] * 4 + ["de"] * 5


def test_learns_behind_a_common_opening(spark):
    rng = np.random.default_rng(3)
    opening = "copyright notice and licence terms of this work " * 60
    data = [(i, opening + " ".join(rng.choice(ROWS[i % 2][0].split(), 600)), ROWS[i % 2][1]) for i in range(80)]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    got = langid.Tagger(model).tag([ROWS[0][0], ROWS[1][0]])
    assert [g[0] for g in got] == ["en", "de"] and min(g[1] for g in got) > 0.8


def test_sampled_rows_are_learned_whole(spark, monkeypatch):
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd"] * 12
    seen = []
    monkeypatch.setattr(langid, "train", lambda rows: seen.extend(rows))
    langid.fit(spark.createDataFrame([(1, ", ".join(words), "en"), (2, "One two, three", "de")], "doc_id long, text string, lang string"))
    assert len(", ".join(words)) > 50_000 and seen == [("one two three", "de"), (" ".join(words), "en")]


def test_long_words_have_all_their_grams():
    words = ["ab", "x" * 5 + "q" * 30 + "middle" + "z" * 40, "a" * 24, "b" * 25]
    feats, owner = langid.word_features(words)
    per = [feats[owner == i] for i in range(len(words))]
    n = [(f < langid.BUCKETS).sum() for f in per]
    assert n == [7 - 2 + 1] + [6 + 1 + len(w) - 1 + len(w) - 2 for w in words[1:]]
    other, at = langid.word_features([words[1].replace("middle", "mittel")])
    assert sorted(per[1].ravel()) != sorted(other[at == 0].ravel())
    # Inner grams are hashed alike wherever they stand, the affixes of a long word from its ends.
    short, _ = langid.word_features(["dle"])
    assert set(short[0, 7:]) <= set(per[1].ravel())
    assert feats[owner == 1][0, 1] == langid.word_features(["z"])[0][0, 1]

import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
from packloom.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    c = bpe._codec(PATH, public_tokenizers.PATTERN)
    return c, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def ids(c, text):
    return np.frombuffer(c.encode([text])[0], "<u4").tolist()


def test_random_texts(pair):
    c, enc = pair
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "1", "23", "\x1c", "\x85", "\xa0", "　", " ", "😀", "中", "the", "!", "\r\n", "\x0b", "A", "'ll", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for t, e in zip(texts, c.encode(texts)):
        assert np.frombuffer(e, "<u4").tolist() == enc.encode_ordinary(t)
        assert c.decode(e) == t.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 5000, "".join(random.Random(1).choice("abcde") for _ in range(20000)), "<|endoftext|>", ""])
def test_long_pieces(pair, text):
    assert ids(pair[0], text) == pair[1].encode_ordinary(text)


def test_a_merge_may_lower_the_rank():
    # "abc" (rank 260) comes before "ab" (261), from which it is made here.
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 260, b"ab": 261}
    enc = tiktoken.Encoding("own", pat_str="[a-z]+", mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(ranks, "[a-z]+")
    for t in ("abcab", "ababc", "abcabcab", "xabyabc"):
        assert ids(c, t) == enc.encode_ordinary(t)


def test_rows(spark, pair):
    texts = [None, "", "Hello  world\n", "x" * 100_000, "Hello  world\n"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.encode_decode(df, PATH, public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, t in enumerate(texts):
        want = pair[1].encode_ordinary(t or "")
        raw = np.array(want, "<u4").tobytes()
        assert got[i].n_tokens == len(want) and got[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and bytes(got[i].decoded) == (t or "").encode()
    assert bpe.encode_decode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_another_pattern_is_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        bpe.encode_decode(df, PATH, "[a-z]+")

import itertools
import random
import re
import time

import duckdb
import pytest

from packloom.llm import licenses

DATA = "/root/testdata/sf0.001"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, label) for i in range(len(words)) for p, label in BASE.items() if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def value(tokens):
    """(labels, restriction) by recursive descent."""
    at = 0

    def unit():
        nonlocal at
        if tokens[at] == "(":
            at += 1
            v = choice()
            at += 1
            return v
        label = licenses.label_of(tokens[at])
        at += 1
        v = ({label}, licenses.RESTRICTION.get(label, 0.5))
        if tokens[at : at + 1] == ["with"]:
            at += 2
            v = (v[0], min(v[1], 0.5))
        return v

    def both():
        nonlocal at
        v = unit()
        while tokens[at : at + 1] == ["and"]:
            at += 1
            w = unit()
            v = (v[0] | w[0], max(v[1], w[1]))
        return v

    def choice():
        nonlocal at
        v = both()
        while tokens[at : at + 1] and tokens[at] in ("or", "/"):
            at += 1
            w = both()
            v = (v[0] | w[0], min(v[1], w[1]))
        return v

    return choice()


def phrase(rng, depth=3):
    if depth == 0 or rng.random() < 0.3:
        x = rng.choice(["mit", "gpl-2.0-only", "apache-2.0", "mpl-2.0", "foo-1", "agpl-3.0+"])
        return f"{x} with classpath-exception-2.0" if rng.random() < 0.3 else x
    s = f" {rng.choice(['and', 'or', '/'])} ".join(phrase(rng, depth - 1) for _ in range(rng.randrange(1, 4)))
    return f"({s})" if rng.random() < 0.5 else s


def test_expressions_equal_recursive_descent():
    rng = random.Random(3)
    for _ in range(500):
        text = phrase(rng)
        tokens = licenses.read_expression(text, 0)
        assert "".join(tokens) == text.replace(" ", "")
        assert licenses.evaluate(tokens) == value(tokens), text


@pytest.mark.parametrize(
    "text,labels,score",
    [
        ("// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "gpl", 0.5),
        ("/* SPDX-License-Identifier: (MIT OR GPL-2.0+) AND BSD-3-Clause */", "bsd,gpl,mit", 0.25),
        ("# SPDX-License-Identifier: LicenseRef-Mine", "other", 0.5),
        ('license = "MIT/Apache-2.0"', "apache,mit", 0.25),
        ('{"license": "AGPL-3.0"}', "agpl", 0.9),
        ("License: see the file. A licence to print money.", "", 0.0),
        ("Licensed under the MPL-2.0.", "mpl", 0.5),
        ("license: (MIT and", "", 0.0),
        ("license: MIT or (GPL-3.0", "mit", 0.25),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", 1.0),
        ("the GNU Affero General Public License", "agpl", 0.9),
    ],
)
def test_labels(text, labels, score):
    got = licenses.Scanner().scan(text)
    assert (got[5], got[6]) == (labels, score)


def test_overlaps_and_words():
    s = licenses.Scanner()
    for text in ("CC BY CC-BY cc by", "mit license apache license", "gnu general public licenses", "x MIT\x00License é", "MIT LICENSEé mit license", "KELVIN K cc by", ""):
        assert s.scan(text)[:5] == brute(text), text
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["cc", "by", "mit", "license", "apache", "gnu", "general", "public", "é"]) + rng.choice([" ", "-", "\n", "", "\x7f"]) for _ in range(30))
        assert s.scan(text)[:5] == brute(text)


def test_linear_time():
    start = time.process_time()
    s = licenses.Scanner()
    for part in ("cc by ", "license: ", "licensed under mit or ", "license: (", "spdx-license-identifier: mit and ", "x", "license license "):
        s.scan(part * (400_000 // len(part)))
    assert time.process_time() - start < 20


def test_rows(spark):
    texts = [None, "", "MIT License", "MIT License", "x" * 100_000 + " mit license"]
    df = spark.createDataFrame([(i if i != 3 else None, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, `a.b` int")
    got = {r.doc_id: tuple(r)[1:6] for r in licenses.scan(df).collect()}
    assert got == {i if i != 3 else None: brute(t) for i, t in enumerate(texts)}
    assert licenses.scan(df.limit(0)).count() == 0


def test_query(spark):
    from packloom.llm import queries

    rows = duckdb.sql(f"select doc_id, text from read_parquet('{DATA}/documents.parquet')").fetchall()
    got = {r.doc_id: tuple(r)[1:6] for r in queries.op13_license_scan(spark, DATA).collect()}
    assert got == {i: brute(t) for i, t in rows} and any(v[1] for v in got.values())
    assert all(set(v[4].split(",")) - {""} <= set(r.labels.split(",")) for v, r in itertools.islice(((got[r.doc_id], r) for r in queries.op13_license_scan(spark, DATA).collect()), 300))

import hashlib
import math
import re
from collections import Counter

from packloom.llm import pii


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


TEXTS = [
    None,
    "",
    "nothing to see here",
    "élan a.b+c@x-y.co.uk, b@c.d+e@f.g and a@b then @x.y 😀 p@q.r",
    "1.2.3.4 1.2.3.999.5.6.7.8 1.2.3.4.5 000.001.002.255 256.1.1.1 12345.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1112 and 41111111111111111111111 x4845168114407329y 1 -2 4111111111111111 2",
    "+1 (017) 555-7713 and ++49 30 1234567 +1-2 +123456789012345678 +1 (487) 555-7209.",
    "a" * 30_000 + "@" + "1" * 30_000 + " " + "9 " * 30_000,
    "1" * 16 + " " + "+12345678 90 " * 300,
]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, email string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for i, t in enumerate(TEXTS):
        want = brute(t or "")
        s = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].spans == s and got[i].base_sha256 == hashlib.sha256(s.encode()).hexdigest()
        n = Counter(k for k, _, _ in want)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(n[k] for k in pii.KINDS)
    assert pii.find(df.limit(0)).count() == 0


def brute_terms(texts, window=64, support=3, least=0.8):
    n, df_t, df_e, df_te, near = len(texts), Counter(), Counter(), Counter(), []
    for t in texts:
        df_t.update({w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)})
        base = brute(t)
        here = []
        for k, a, b in base:
            lo, hi = max(0, a - window), min(len(t), b + window)
            for off, part in ((lo, t[lo:a]), (b, t[b:hi])):
                for m in re.finditer(r"[^\W\d_]{3,}", part):
                    s, e = off + m.start(), off + m.end()
                    if (s > lo or lo == 0) and (e < hi or hi == len(t)) and not any(s < y and x < e for _, x, y in base):
                        here.append((f"{k}:{t[a:b].lower()}", m[0].lower(), s, e))
        df_e.update({f"{k}:{t[a:b].lower()}" for k, a, b in base})
        df_te.update({x[:2] for x in here})
        near.append(here)
    out = []
    for here in near:
        flagged = set()
        for e, w, a, b in here:
            ic = math.log(n / df_e[e])
            if df_te[e, w] >= support and ic > 0 and math.log(n * df_te[e, w] / (df_t[w] * df_e[e])) / ic >= least:
                flagged.add((a, b))
        out.append(sorted(flagged))
    return out


CORPUS = ["write to jane@corp.example at Kestrel about rates today"] * 2 + ["ask Kestrel desk: jane@corp.example now", "the desk and the rates are here today"] * 2 + ["plain text of the day about rates %d" % i for i in range(20)]


def test_terms(spark):
    df = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    want = brute_terms(CORPUS)
    assert want[0] == [(30, 37)]
    for i in range(len(CORPUS)):
        assert [tuple(map(int, s.split(":")[1:])) for s in got[i].spans.split(",") if s.startswith("term")] == want[i]
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0] == "write to [EMAIL] at  about rates today" and clean[6] == CORPUS[6] and len(clean) == len(CORPUS)


def test_terms_of_whole_texts_and_shared_entities(spark):
    far = "Kestrel opens. " + "a day of rates and words, " * 8 + "so write to {}@corp.example 😀 today; Kestrel"
    texts = [far.format(n) for n in ("ann", "bob", "cyd")] + ["Kestrel: call {}".format(p) for p in ("nobody",)]
    texts += ["Osprey desk, +1 (017) 555-77%d3" % i for i in range(3)] + ["a day of rates and words, so write today call %d desk" % i for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "term"] for r in pii.find(df).collect()}
    # No value recurs; the domain and the number prefix do, and Kestrel stands more
    # than 64 characters from the address.
    assert all("Kestrel" == got[i][0] == got[i][-1] and got[i].count("Kestrel") == 2 for i in range(3))
    assert all("Osprey" in got[i] for i in range(4, 7)) and not any(got[i] for i in [3, *range(7, len(texts))])
    assert not any("day" in x or "write" in x for x in got.values())
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("Osprey" not in clean[i] and "Kestrel" not in clean[i - 4] for i in range(4, 7)) and clean[3] == texts[3]


def test_pairs_that_cannot_disclose_are_dropped_before_a_shuffle(spark, monkeypatch):
    """What meets in a join by entity and term grows with what may be disclosed."""
    rows = [(i, f"common words everywhere mail{i % 5}@site{i % 3}.org special{i % 5}") if i % 4 == 0 else (i, "common words everywhere") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    plain = pii.disclosing
    monkeypatch.setattr(pii, "disclosing", lambda entity, pairs, *rest: seen.append({r.term for r in pairs.collect()}) or plain(entity, pairs, *rest))
    got = {r.doc_id: r.n_term for r in pii.find(df).collect()}
    assert seen == [{"special"}]
    assert all(got[i] == (1 if i % 4 == 0 else 0) for i, _ in rows)


def test_bitmap_keeps_all_that_is_wanted(spark):
    rows = spark.range(5000).selectExpr("concat('e', id % 50) AS entity", "concat('t', id) AS term", "id")
    wanted = rows.where("id % 97 = 3").select("entity", "term")
    got = {r.id for r in pii._among(rows, wanted, ["entity", "term"]).collect()}
    assert {i for i in range(5000) if i % 97 == 3} <= got and len(got) < 60
    assert pii._among(rows, wanted.limit(0), ["entity", "term"]).count() == 0

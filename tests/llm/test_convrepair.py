import hashlib
import itertools
import random
import re
import zlib

import pytest

from packloom.llm import convrepair

SCHEMA = "conv_id long, turn long, role string, text string, conv int, pos int"
LEGAL = re.compile(r"(s?(ua)+)?")


def judged(rows):
    """Rows in order, each with its first fault."""
    seen, out = set(), []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        core = re.search(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)", text)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[0] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, lines) by all strings of edits, row by row, with the least cost and
    then the least string of each role prefix."""
    state = {"": (0, "", ())}

    def put(table, roles, value):
        if re.fullmatch(r"s?(ua)*u?", roles) and (roles not in table or value[:2] < table[roles][:2]):
            table[roles] = value

    def insert(table):
        # An insertion before a deletion is never less than one after it.
        todo = list(table)
        for roles in todo:
            cost, audit, lines = table[roles]
            for r, name in (("u", "user:"), ("a", "assistant:")):
                if (roles + r not in table or (cost + 2, audit + "I") < table[roles + r][:2]) and len(roles) < 2 * len(rows) + 3:
                    put(table, roles + r, (cost + 2, audit + "I", (*lines, name)))
                    if roles + r in table and table[roles + r][1] == audit + "I":
                        todo.append(roles + r)
        return table

    insert(state)
    for _, role, text, fault in rows:
        after = {}
        for roles, (cost, audit, lines) in state.items():
            put(after, roles, (cost + 3, audit + "D", lines))
            if fault in ("", "truncated"):
                more = fault == "truncated"
                put(after, roles + role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    put(after, roles + name[0], (cost + 2 + more, audit + "R", (*lines, f"{name}:{text}")))
        state = insert(after)
    return min(v for k, v in state.items() if LEGAL.fullmatch(k))


def brute(rows):
    rows = judged(rows)
    turns = [t for t, *_ in rows if t is not None]
    cost, audit, lines = cheapest(rows)
    n = lambda f: sum(r[3] == f for r in rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def random_rows(rng, size):
    out = []
    for t in range(rng.randrange(1, size)):
        row = (rng.choice([t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", " "]), rng.choice(["Yes.", "No!", "a", " ", "", "Why?\n", f"t{t}", f"t{t}."]))
        out += [row] * rng.choice([1, 1, 1, 2])
    return out


@pytest.mark.parametrize("bits", [convrepair.FRAGMENT_BITS, 1])
def test_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(convrepair, "FRAGMENT_BITS", bits)
    rng = random.Random(7)
    convs = {i: random_rows(rng, 8) for i in range(150)}
    convs[None] = random_rows(rng, 8)
    df = spark.createDataFrame([(c, *r, 1, 2) for c, rows in convs.items() for r in rows], SCHEMA).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in convrepair.Repair(df).summaries().collect()}
    assert got == {c: brute(rows) for c, rows in convs.items()}


def test_lines_follow_the_grammar(spark):
    rows = [(1, t, "user", f"line {t}.", 0, 0) for t in range(300)]
    got = sorted(convrepair.Repair(spark.createDataFrame(rows, SCHEMA)).lines().collect(), key=lambda r: (r.pos, r.at))
    assert LEGAL.fullmatch("".join(r.role[0] for r in got)) and sum(r.text != "" for r in got) >= 300 - 1


def test_damage(spark):
    rows = [(c, t, "system" if t == 0 else ("user", "assistant")[t % 2], f"c{c} t{t}. And?", 1, 1) for c in range(40) for t in range(6)]
    rows += [(None, None, None, None, 1, 1), (77, 1, "user", "x", 1, 1), (77, None, None, "y", 1, 1)]
    want = {}
    for c, t, role, text, *_ in rows:
        part = lambda v: " " if v is None else str(v)
        role, text = role or " ", " " if text is None else text
        f = zlib.crc32(f"{part(c)}:{part(t)}".encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        want.setdefault(c, []).extend([(t, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in convrepair.damage_and_repair(df).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: brute(r) if r else empty for c, r in want.items()}
    assert convrepair.damage_and_repair(df.limit(0)).count() == 0


def test_one_long_conversation(spark):
    df = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 1 THEN 'assistant' ELSE 'user' END AS role", "concat('t', id % 9000, '.') AS text")
    r = convrepair.Repair(df).summaries().first()
    assert r.audit.count("D") >= r.duplicate > 0 and len(r.audit) >= 20_000 and r.gaps == 0

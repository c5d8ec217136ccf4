"""Secrets in text, source and configuration files.

Three base patterns (assignments to well-known names, access keys, long hex
strings) are joined by an assignment-aware lexer. It cuts a text into names, string
literals (single, double, back-quoted and triple-quoted, with escapes), operators
and bare words, and reads them as definitions: ``name = "v"``, ``name: v``,
``"name": "v"``, ``name := 'v'``, ``name => 'v'``, ``const name: T = v``,
``map["name"] = v``, attributes and elements of markup, and pairs of a ``key`` and a
``value`` attribute. A right-hand side is a sum of literals and names. Names stand
for what the same text gives them, before the use or else after it (constant
propagation through any number of steps), and the literals of a sum are one value.
Every literal is scored by how sensitive the names are that it reaches and by the
form of the value; from ``threshold`` on it becomes a span of kind ``literal``, also
where a base span covers it, as it is the secret itself.

Defined results: a null text is the empty text; repeated rows give equal values;
extra columns are ignored; positions are code points, ends exclusive; names that
define each other have the literals that they meet, once.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from packloom.runtime import prepare, renamed

THRESHOLD = 4.0


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|[aA][pP][iI]_?[kK][eE][yY]"
#: Base patterns and the least length of a match (of group 2 for the first).
#: A run of hex digits is matched only where it is long enough: runs are maximal.
ASSIGN = re.compile(f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

#: Weight of a word in a target's name.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 2.5, "passphrase": 3.0, "secret": 3.0, "token": 2.5,
    "apikey": 3.0, "authkey": 2.5, "accesskey": 3.0, "privatekey": 3.0, "secretkey": 3.0, "credential": 2.5,
    "credentials": 2.5, "auth": 1.5, "key": 1.0, "pass": 1.5, "signature": 1.0, "salt": 1.0, "pin": 1.0,
}
_HINT = re.compile("passw|pwd|passphrase|secret|token|key|credential|auth|pass|signature|salt|pin", re.I)
#: Tokens. Repeats are possessive, so literals and names of any length are read once.
#: An apostrophe inside a word opens no literal; a prefix such as b or f does.
_OPEN = r"(?:(?<!\w)|(?<=\b[bBrRuUfF])|(?<=\b[bBrRfF][bBrRfF]))"
_TOKEN = re.compile(
    rf"""{_OPEN}(?P<q3>\"\"\"|\'\'\')(?P<t3>(?:\\[\s\S]|(?!(?P=q3))[^\\])*+)(?P=q3)
    |{_OPEN}(?P<q1>["'])(?P<t1>(?:\\[\s\S]|(?!(?P=q1))[^\\\r\n])*+)(?P=q1)
    |{_OPEN}`(?P<t0>(?:\\[\s\S]|[^\\`])*+)`
    |(?P<name>[A-Za-z_$][\w$]*+(?:[.-][\w$]++)*+)
    |(?P<op>:=|=>|==|!=|<=|>=|::|[=:+.,;()\[\]{{}}\\\n])
    |(?P<other>[^\s"'`=:+.,;()\[\]{{}}\\\w]|\w++)""",
    re.X,
)
_ASSIGNS = {"=", ":", ":=", "=>"}
#: An unquoted value, and where a sum goes on.
_BARE = re.compile(r"[^\s\"'`,;()\[\]{}<>]++")
_TAG = re.compile(r"<(?P<tag>[A-Za-z][\w:.-]*+)(?P<rest>(?:[^<>\"']|\"[^\"<>]*+\"|'[^'<>]*+')*+)>(?P<body>[^<>]*+)(?P<end></)?")
_ATTRIBUTE = re.compile(r"([A-Za-z_][\w:.-]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)')")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|changeme|example|placeholder|none|null|true|false|your[-_ ].*|<.*>|\$\{.*\}|%\(.*\))\Z")


def name_score(name: str) -> float:
    """The largest weight of the words of a name, and of neighbours joined."""
    words = [w.lower() for w in _CAMEL.findall(name.replace("$", " "))]
    joined = [a + b for a, b in zip(words, words[1:])]
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *joined]), default=0.0)


def literal_score(value: str) -> float:
    """Up to 3 points: length, mixture of character classes and entropy."""
    n = len(value)
    if n < 6 or _PLACEHOLDER.match(value) or " " in value:
        return 0.0
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return min(n, 24) / 24 + (classes - 1) / 3 + min(entropy, 4.0) / 4


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by start, then kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@dataclass
class Definition:
    """A name, where it is given its value, and the parts of that value: (text,
    start, end, whether it is a name that may stand for a constant)."""

    name: str
    at: int
    parts: list


def _tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end); the span of a literal is that of its content."""
    out = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind in ("t3", "t1", "t0"):
            out.append(("text", m[kind], *m.span(kind)))
        else:
            out.append((kind, m[0], m.start(), m.end()))
    return out


def _target(tokens: list, i: int) -> str | None:
    """The name that the operator at ``i`` gives a value to."""
    kind, value = tokens[i - 1][:2] if i else ("op", "")
    if kind == "name":
        # ``name: Type = value``
        typed = tokens[i][1] == "=" and i >= 3 and tokens[i - 2][1] == ":" and tokens[i - 3][0] == "name"
        return tokens[i - 3][1] if typed else value
    if kind == "text":
        return value
    if value == "]" and i >= 3 and tokens[i - 2][0] == "text" and tokens[i - 3][1] == "[":
        return tokens[i - 2][1]
    return None


def _value(text: str, tokens: list, i: int) -> list:
    """The parts of the right-hand side that begins at token ``i``."""
    parts: list = []
    while i < len(tokens) and tokens[i][1] == "(" and tokens[i][0] == "op":
        i += 1
    while i < len(tokens):
        kind, value, start, end = tokens[i]
        if kind == "name" and len(value) < 3 and i + 1 < len(tokens) and tokens[i + 1][0] == "text" and text[end] in "'\"":
            i += 1  # a prefix of the literal
            continue
        if kind == "text":
            parts.append((value, start, end, False))
        elif kind == "name" and (i + 1 == len(tokens) or tokens[i + 1][1] not in ("(", "[")):
            bare = _BARE.match(text, start)
            if bare and bare.end() > end:  # a longer unquoted value, such as a/b+c
                parts.append((bare[0], *bare.span(), False))
                break
            parts.append((value, start, end, True))
        elif kind == "other" and value not in "<>|&" and not parts:
            bare = _BARE.match(text, start)
            if bare:
                parts.append((bare[0], *bare.span(), False))
            break
        else:
            break
        # A sum goes on after + or . or with the next literal.
        i += 1
        while i < len(tokens) and tokens[i][1] == "\\":
            i += 2 if i + 1 < len(tokens) and tokens[i + 1][1] == "\n" else 1
        if i < len(tokens) and tokens[i][0] == "op" and tokens[i][1] in "+.":
            i += 1
            while i < len(tokens) and tokens[i][1] == "\n":
                i += 1
        elif not (kind == "text" and i < len(tokens) and tokens[i][0] == "text"):
            break
    return parts


def definitions(text: str) -> list[Definition]:
    """The definitions of a text, in order."""
    tokens = _tokens(text)
    out = []
    inside = 0  # up to here an unquoted value goes, whose operators are its own
    for i, (kind, value, start, _) in enumerate(tokens):
        if kind == "op" and value in _ASSIGNS and start >= inside:
            name = _target(tokens, i)
            if name:
                parts = _value(text, tokens, i + 1)
                if parts:
                    inside = max(inside, parts[-1][2]) if not parts[-1][3] else inside
                    out.append(Definition(name, start, parts))
    if "<" in text:
        for m in _TAG.finditer(text):
            base = m.start("rest")
            found = {}
            for a in _ATTRIBUTE.finditer(m["rest"]):
                g = 2 if a[2] is not None else 3
                found[a[1].lower()] = (a[g], base + a.start(g), base + a.end(g), False)
            named = next((found[k][0] for k in ("key", "name", "id") if k in found), None)
            given = next((found[k] for k in ("value", "content", "default") if k in found), None)
            if named and given:
                out.append(Definition(named, m.start(), [given]))
            body = m["body"].strip()
            if m["end"] and body:
                at = m.start("body") + m["body"].index(body)
                out.append(Definition(m["tag"], m.start(), [(body, at, at + len(body), False)]))
    return sorted(out, key=lambda d: d.at)


def _resolved(found: list[Definition]) -> list[list[tuple[str, int, int]]]:
    """The literals that each definition reaches."""
    by: dict[str, list[int]] = {}
    for i, d in enumerate(found):
        by.setdefault(d.name, []).append(i)

    def meant(name: str, user: int) -> int | None:
        """The last definition of a name before its use, else the first one."""
        own = by.get(name)
        if not own:
            return None
        k = bisect_left(own, user)
        return own[k - 1] if k else next((x for x in own if x != user), None)

    done: dict[int, list] = {}
    for first in range(len(found)):
        stack, open_ = [first], set()
        while stack:
            i = stack[-1]
            if i in done:
                stack.pop()
                continue
            uses = [meant(p[0], i) if p[3] else None for p in found[i].parts]
            wait = [u for u in uses if u is not None and u not in done and u not in open_]
            open_.add(i)
            if wait:
                stack += wait
                continue
            parts = {}
            for (value, start, end, is_name), u in zip(found[i].parts, uses):
                if u is not None:
                    parts |= {x[1:]: x for x in done.get(u, ())}
                elif not is_name or any(c.isdigit() for c in value):  # else an unknown name
                    parts[start, end] = (value, start, end)
            done[i] = list(parts.values())
            stack.pop()
    return [done[i] for i in range(len(found))]


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """Literals whose score, under any name that they reach, meets ``threshold``."""
    if not (("=" in text or ":" in text or "<" in text) and _HINT.search(text)):
        return []
    found = definitions(text)
    best: dict[tuple[int, int], float] = {}
    for d, parts in zip(found, _resolved(found)):
        weight = name_score(d.name)
        if weight and parts:
            score = weight + literal_score("".join(p[0] for p in parts))
            for _, start, end in parts:
                if end > start:
                    best[start, end] = max(best.get((start, end), 0.0), score)
    return sorted(("literal", a, b) for (a, b), score in best.items() if score >= threshold)


def find_spans(text: str | None, threshold: float = THRESHOLD) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans (start, then base kinds, then literals)."""
    text = text or ""
    base = base_spans(text)
    extra = literal_spans(text, threshold)
    order = {k: i for i, k in enumerate((*KINDS, "literal"))}
    return base, sorted(base + extra, key=lambda s: (s[1], order[s[0]]))


def render(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """DataFrame[key, n_assign, n_access, n_hex, n_literal, base_sha256, spans]."""
    work, _, (k, t) = renamed(df, key, text)
    kind = dict(work.dtypes)[k]
    names = [k, "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = []
                for t in part.column(1):
                    base, spans = find_spans(t.as_py(), threshold)
                    n = Counter(k for k, _, _ in spans)
                    rows.append((*(n[k] for k in KINDS), n["literal"], hashlib.sha256(render(base).encode()).hexdigest(), render(spans)))
                types = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows), types))], names=names)

    prepare(df.sparkSession)
    return work.select(k, t).mapInArrow(run, f"{k} {kind}, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string").withColumnRenamed(k, key)

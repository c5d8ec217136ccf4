"""Licences named in text.

Words (runs of ASCII letters, digits and other characters beyond ASCII, A-Z in lower
case) are joined by single spaces, and one Aho-Corasick automaton over them finds notice
phrases and identifier tags, overlapping ones as well. Behind a tag, which has to be
followed by its separator, an expression is read from the text: licence identifiers,
parentheses, ``and``, ``or`` (also ``/``) and ``with``. It ends before the first token
that can't continue it, and is cut back to where it was last complete. A shunting-yard
parser orders it by precedence (``with``, ``and``, ``or``) and evaluates it.

An expression's value is its labels and its restriction: that of a licence comes from its
kind (0.1 public domain, 0.25 permissive, 0.5 weak copyleft or unknown, 0.75 strong
copyleft, 0.9 network copyleft, 1 no commercial use or no changes), ``and`` takes the
larger, ``or`` the smaller, as one may choose, and an exception (``with``) leaves at most
weak copyleft. A text's score is the largest restriction of its expressions and phrases,
0 where there is none.

Defined results: a null text is the empty text, with no words, no labels, null first and
last word and score 0; repeated rows give equal values; extra columns are ignored; a tag
without a readable expression counts as a tag and gives no label; an identifier that is
not known gives ``other`` behind an SPDX tag, and makes an expression behind any other tag
void if no identifier in it is known. Texts are read whole and in linear time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packloom.runtime import prepare, renamed

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Further notice phrases, in words.
PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "eclipse distribution license": "bsd",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "boost software license": "boost",
    "isc license": "isc",
    "zlib license": "zlib",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "free and unencumbered software released into the public domain": "unlicense",
    "artistic license": "artistic",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivs": "cc-by-nd",
    "licence publique generale gnu": "gpl",
}
#: Identifiers, with or without a version behind a hyphen, and their labels.
IDENTIFIERS = {
    "mit": "mit", "mit-0": "mit", "x11": "mit", "expat": "mit", "apache": "apache", "gpl": "gpl", "gplv2": "gpl", "gplv3": "gpl",
    "lgpl": "lgpl", "lgplv2": "lgpl", "lgplv3": "lgpl", "agpl": "agpl", "agplv3": "agpl", "gfdl": "gfdl", "bsd": "bsd", "0bsd": "bsd",
    "mpl": "mpl", "epl": "epl", "cddl": "cddl", "eupl": "eupl", "bsl": "boost", "boost": "boost", "isc": "isc", "zlib": "zlib",
    "unlicense": "unlicense", "wtfpl": "wtfpl", "artistic": "artistic", "python": "python", "psf": "python", "postgresql": "postgresql",
    "cc0": "cc0", "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nc-sa": "cc-by-nc", "cc-by-nd": "cc-by-nd",
    "cc-by-nc-nd": "cc-by-nc", "sspl": "sspl", "ofl": "ofl", "ncsa": "ncsa", "ms-pl": "ms-pl",
}
RESTRICTION = {
    "unlicense": 0.1, "wtfpl": 0.1, "cc0": 0.1, "mit": 0.25, "apache": 0.25, "bsd": 0.25, "isc": 0.25, "zlib": 0.25, "boost": 0.25,
    "python": 0.25, "postgresql": 0.25, "ncsa": 0.25, "ms-pl": 0.25, "cc-by": 0.25, "artistic": 0.5, "mpl": 0.5, "epl": 0.5, "cddl": 0.5,
    "lgpl": 0.5, "ofl": 0.5, "gpl": 0.75, "gfdl": 0.75, "eupl": 0.75, "cc-by-sa": 0.75, "agpl": 0.9, "sspl": 0.9, "cc-by-nc": 1.0, "cc-by-nd": 1.0,
}
WEAK = 0.5
OTHER = "other"

_AFTER_KEY = re.compile(r"""["']?[ \t]*[:=]=?>?[ \t]*\[?["']?""")
_AFTER_VERB = re.compile(r"[ \t]+(?:(?:the|either|both|of|terms|your|choice)[ \t]+)*")
#: Identifier tags, in words, and what stands between one and its expression.
TAGS = {
    "spdx license identifier": _AFTER_KEY,
    "license expression": _AFTER_KEY,
    "license": _AFTER_KEY,
    "licence": _AFTER_KEY,
    "licenses": _AFTER_KEY,
    "licensed under": _AFTER_VERB,
    "released under": _AFTER_VERB,
    "distributed under": _AFTER_VERB,
}
SPDX = "spdx license identifier"

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_TOKEN = re.compile(r"[ \t]*([()/]|[a-z0-9][a-z0-9.+-]*)")
_OPERATORS = {"or": 1, "/": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    """The label of an identifier: its own, or that of the longest known part up to a
    hyphen; ``other`` if none is known."""
    name = identifier.rstrip("+")
    while name:
        if name in IDENTIFIERS:
            return IDENTIFIERS[name]
        name = name.rpartition("-")[0]
    return OTHER


def read_expression(text: str, at: int) -> list[str]:
    """Tokens of the longest complete expression at ``at``, empty if there is none."""
    tokens: list[str] = []
    depth = complete = 0
    operand = False  # whether the last token ended an operand
    while m := _TOKEN.match(text, at):
        token = m[1] if m[1] in "()/" else m[1].rstrip(".-") or m[1]
        after_with = bool(tokens) and tokens[-1] == "with"
        if token == "(":
            if operand or after_with:
                break
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            depth -= 1
        elif token in _OPERATORS:
            if not operand or token == "with" and tokens[-1] == ")":
                break
            operand = False
        else:
            if operand:
                break
            operand = True
        tokens.append(token)
        if operand and not depth:
            complete = len(tokens)
        if m[1][-1] == "." and m[1] != token:
            break  # the sentence ends here
        at = m.end()
    return tokens[:complete]


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operators behind their operands. ``tokens`` are complete."""
    out: list[str] = []
    stack: list[str] = []
    for t in tokens:
        if t == "(":
            stack.append(t)
        elif t == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif t in _OPERATORS:
            while stack and stack[-1] != "(" and _OPERATORS[stack[-1]] >= _OPERATORS[t]:
                out.append(stack.pop())
            stack.append(t)
        else:
            out.append(t)
    return out + stack[::-1]


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """Labels and restriction of a complete expression."""
    labels: set[str] = set()
    stack: list[tuple[float, str]] = []
    order = postfix(tokens)
    exceptions = {i for i, t in enumerate(order) if i + 1 < len(order) and order[i + 1] == "with"}
    for i, t in enumerate(order):
        if t in _OPERATORS:
            (b, _), (a, _) = stack.pop(), stack.pop()
            stack.append((min(a, WEAK) if t == "with" else max(a, b) if t == "and" else min(a, b), ""))
        elif i in exceptions:
            stack.append((0.0, t))
        else:
            label = label_of(t)
            labels.add(label)
            stack.append((RESTRICTION.get(label, WEAK), t))
    return labels, stack[0][0]


class Scanner:
    """The automaton over words and what is read at its hits."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, list[tuple[str, str]]] = {}
        for kind, table in (("base", BASE), ("phrase", PHRASES), ("tag", TAGS)):
            for words in table:
                kinds.setdefault(words, []).append((kind, words))
        for words, found in kinds.items():
            self.automaton.add_word(f" {words} ", (len(words) + 2, found))
        self.automaton.make_automaton()

    def scan(self, text: str | None):
        """(n_words, n_base, first_word, last_word, base labels, labels, score, n_tags,
        expressions)."""
        low = (text or "").encode().lower().decode()
        words = WORD.findall(low)
        joined = f" {' '.join(words)} "
        hits = [(end - size + 1, kind, name) for end, (size, found) in self.automaton.iter(joined) for kind, name in found]
        if not hits:
            return (len(words), 0, None, None, "", "", 0.0, 0, "")
        # A word begins where the space before it does, in the joined text.
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)[:-1]])
        places, base, labels, score, tags, expressions = [], set(), set(), 0.0, 0, []
        at_tags = []
        for at, kind, name in hits:
            if kind == "base":
                places.append(int(np.searchsorted(starts, at)))
                base.add(BASE[name])
            if kind == "tag":
                at_tags.append((int(np.searchsorted(starts, at)) + name.count(" "), name))
            else:
                label = BASE[name] if kind == "base" else PHRASES[name]
                labels.add(label)
                score = max(score, RESTRICTION[label])
        if at_tags:
            ends = [m.end() for m in WORD.finditer(low)]
            known_at = {w for w, name in at_tags if name not in ("license", "licence")}
            for word, name in at_tags:
                # The shorter tag at the end of a longer one is the same place.
                between = TAGS[name].match(low, ends[word])
                if not between or name in ("license", "licence") and word in known_at:
                    continue
                tags += 1
                tokens = read_expression(low, between.end())
                if not tokens:
                    continue
                found, value = evaluate(tokens)
                if name == SPDX or found - {OTHER}:
                    labels |= found
                    score = max(score, value)
                    expressions.append(" ".join(tokens))
        first, last = (min(places), max(places)) if places else (None, None)
        return (len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, tags, ",".join(expressions))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """DataFrame[key, n_words, n_base, first_word, last_word, base_labels, labels, score,
    n_tags, expressions]."""
    work, _, (k, t) = renamed(df, key, text)
    kind = dict(work.dtypes)[k]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_tags", "expressions"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.string()]

    def run(batches):
        scanner = Scanner()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = [scanner.scan(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), x) for c, x in zip(zip(*rows), types))], names=[k, *names])

    prepare(df.sparkSession)
    schema = f"{k} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long, expressions string"
    return work.select(k, t).mapInArrow(run, schema).withColumnRenamed(k, key)

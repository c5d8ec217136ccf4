"""Columns over HTML text: plain text, normalised forms, tags, references, URLs.

All are built-in expressions, so they run in the JVM and fuse with the scan.
Entities are decoded natively for the basic set; ``packloom.functions.arrow``
has the full table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entities that the native decoder knows, the ampersand last.
BASIC_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def java_pattern(pattern: str, flags: str = "") -> str:
    """A pattern of Python's syntax in Java's, with flags i, m and s inlined."""
    out = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    on = "".join(f for f in "ims" if f in flags.lower())
    return f"(?{on}){out}" if on else out


def java_replacement(text: str) -> str:
    """A replacement of Python's syntax in Java's."""
    out = text.replace("$", r"\$")
    out = re.sub(r"\\g<(\w+)>", r"${\1}", out)
    return re.sub(r"\\(\d)", r"$\1", out)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decode_basic(text: Column) -> Column:
    for entity, char in BASIC_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain_text(text: Column, drop_scripts: bool = False) -> Column:
    """Tags out, entities decoded, white space collapsed; ``drop_scripts`` also
    takes scripts, styles and comments with what they hold."""
    if drop_scripts:
        text = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
        text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    return collapse(decode_basic(F.regexp_replace(text, r"<[^>]+>", " ")))


def compare_key(text: Column, gap: str = " ") -> Column:
    """Lower case, & as "and", only letters, digits and blanks; other characters
    become ``gap`` (a blank or nothing: the callers differ)."""
    low = F.replace(F.lower(text), F.lit("&"), F.lit("and"))
    return collapse(F.regexp_replace(low, "[^a-z0-9 ]+", gap))


#: Length of the heads by which texts that another holds are found.
GRAM = 4


def held_parts(keys: DataFrame, key: str, texts: DataFrame, text: str) -> DataFrame:
    """``keys`` with ``part``: each substring of a key that begins with the first GRAM
    characters of a text and is as long as such a text (the text itself where that is
    shorter than GRAM). Every text that a key holds is one of its parts, so what texts and
    keys have to do with each other is a join by equal parts, and rows grow with the
    characters of the keys, not with pairs."""
    k = F.col(key)
    left = lambda i: F.length(k) - i + 1
    head = lambda i, n: F.struct(i.alias("at"), F.substring(k, i, n).alias("head"))
    heads = F.flatten(F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), left(i))), lambda n: head(i, n))))
    starts = texts.where(F.col(text) != "").groupBy(F.substring(text, 1, GRAM).alias("__head")).agg(F.collect_set(F.length(text)).alias("__lengths"))
    rows = keys.where(k != "").withColumn("__x", F.explode(heads)).select(*keys.columns, F.col("__x.at").alias("__at"), F.col("__x.head").alias("__head"))
    rows = rows.join(starts.hint("merge"), "__head")
    fits = F.filter("__lengths", lambda n: n <= left(F.col("__at")))
    return rows.select(*keys.columns, F.explode(F.transform(fits, lambda n: F.substring(k, F.col("__at"), n))).alias("part"))


def fold(text: Column) -> Column:
    """Lower case with collapsed white space."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def header_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_match(text: Column, pattern: str, group: int) -> Column:
    """Null where the pattern does not occur."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def title_text(text: Column) -> Column:
    return plain_text(F.regexp_extract(text, r"(?is)<title\b[^>]*>(.*?)</title>", 1))


def headings(text: Column) -> Column:
    """Array of plain heading texts in order."""
    return F.transform(matches(text, r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>", 1), lambda x: plain_text(x))


def heading_levels(text: Column) -> Column:
    return F.transform(matches(text, r"(?i)<h([1-6])\b", 1), lambda x: x.cast("int"))


def references(text: Column) -> Column:
    """Values of href and src attributes in order."""
    return matches(text, r"""(?i)\b(?:href|src)\s*=\s*["']([^"']+)["']""", 1)


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute's value, null if the tag has none."""
    return first_match(tag, rf"""(?is)\b{re.escape(name)}\s*=\s*(["'])(.*?)\1""", 2)


def url_path(url: Column) -> Column:
    """Without fragment and query."""
    return F.trim(F.regexp_replace(url, r"[#?].*$", ""))


def is_local(url: Column) -> Column:
    """A relative reference to a file of the package."""
    low = F.lower(F.trim(url))
    return (low != "") & ~low.rlike(r"^(?:[a-z][a-z0-9+.-]*:|//|#|/)")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def style_map(style: Column) -> Column:
    """map<property, value> of an inline style: keys lower-cased, parts without a
    colon skipped, the last of equal keys wins."""
    parts = F.filter(F.split(style, ";"), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.regexp_extract(p, r"(?s)^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(p, r"(?s)^[^:]*:(.*)$", 1)).alias("v")))
    pairs = F.filter(pairs, lambda p: (p.k != "") & (p.v != ""))
    last = lambda xs, k: F.element_at(F.filter(xs, lambda p: p.k == k), -1).v
    # Values inside lambdas are not shared by the optimizer, so each is bound once.
    return let(pairs, lambda xs: let(F.array_distinct(F.transform(xs, lambda p: p.k)), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: last(xs, k)))))

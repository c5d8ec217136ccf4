"""Rule-driven operators: ordered replacements, literal rewrites, banner, triggers.

The text column is rewritten rule by rule; each rule's count is taken on the
text as the rules before left it. All rules are built-in expressions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.html import count_of, java_pattern, java_replacement

CHANGE = "array<struct<category:string,description:string,count:bigint>>"
ISSUE = "array<struct<reason:string,evidence:string>>"


@dataclass(frozen=True)
class Replacement:
    description: str
    pattern: str
    replacement: str
    flags: str = ""


@dataclass(frozen=True)
class Rewrite:
    description: str
    source: str
    target: str


@dataclass(frozen=True)
class Trigger:
    reason: str
    pattern: str
    flags: str = ""


@dataclass(frozen=True)
class Banner:
    enabled: bool = False
    html: str = ""
    insert_mode: str = "prepend_body"


@dataclass(frozen=True)
class Rules:
    replacements: list[Replacement] = field(default_factory=list)
    rewrites: list[Rewrite] = field(default_factory=list)
    triggers: list[Trigger] = field(default_factory=list)
    banner: Banner = Banner()


def load_rules(text: str) -> Rules:
    """Rules from JSON; missing parts are empty."""
    d = json.loads(text)
    return Rules(
        [Replacement(r.get("description", ""), r["pattern"], r.get("replacement", ""), r.get("flags", "")) for r in d.get("replacements", [])],
        [Rewrite(r.get("description", ""), r["from"], r["to"]) for r in d.get("link_rewrites", [])],
        [Trigger(r["reason"], r["pattern"], r.get("flags", "")) for r in d.get("manual_review_triggers", [])],
        Banner(**{k: v for k, v in d.get("banner", {}).items() if k in ("enabled", "html", "insert_mode")}),
    )


def _note(df: DataFrame, category: str, description: str, count: Column) -> DataFrame:
    one = F.array(F.struct(F.lit(category).alias("category"), F.lit(description).alias("description"), count.cast("long").alias("count")))
    return df.withColumn("changes", F.when(count > 0, F.concat("changes", one)).otherwise(F.col("changes")))


def _with_changes(df: DataFrame) -> DataFrame:
    return df if "changes" in df.columns else df.withColumn("changes", F.array().cast(CHANGE))


def apply_replacements(df: DataFrame, rules: list[Replacement], text: str = "html") -> DataFrame:
    df = _with_changes(df)
    for r in rules:
        p = java_pattern(r.pattern, r.flags)
        df = _note(df.withColumn("__n", count_of(F.col(text), p)), "replacement", r.description, F.col("__n"))
        df = df.withColumn(text, F.when(F.col("__n") > 0, F.regexp_replace(text, p, java_replacement(r.replacement))).otherwise(F.col(text)))
    return df.drop("__n")


def apply_rewrites(df: DataFrame, rules: list[Rewrite], text: str = "html") -> DataFrame:
    df = _with_changes(df)
    for r in rules:
        gone = F.length(text) - F.length(F.replace(text, F.lit(r.source), F.lit("")))
        df = _note(df.withColumn("__n", (gone / len(r.source)).cast("long")), "link_rewrite", r.description, F.col("__n"))
        df = df.withColumn(text, F.replace(text, F.lit(r.source), F.lit(r.target)))
    return df.drop("__n")


def apply_banner(df: DataFrame, banner: Banner, text: str = "html") -> DataFrame:
    """Once per page: a page that holds the banner in any case stays as it is."""
    df = _with_changes(df)
    if not banner.enabled or not banner.html.strip():
        return df
    t = F.col(text)
    body = r"(?is)^(.*?<body[^>]*>)(.*)$"
    top = F.concat(F.lit(banner.html + "\n"), t)
    inside = F.concat(F.regexp_extract(t, body, 1), F.lit("\n" + banner.html + "\n"), F.regexp_extract(t, body, 2))
    new = F.when(t.rlike(r"(?i)<body[^>]*>"), inside).otherwise(top) if banner.insert_mode == "prepend_body" else top
    df = df.withColumn("__n", (~F.contains(F.lower(t), F.lit(banner.html.strip().lower()))).cast("int"))
    df = _note(df, "template", "Injected course template banner", F.col("__n"))
    return df.withColumn(text, F.when(F.col("__n") == 1, new).otherwise(t)).drop("__n")


def triggered(text: Column, triggers: list[Trigger]) -> Column:
    """array<struct<reason, evidence>>: the first match of each trigger."""
    found = []
    for t in triggers:
        p = java_pattern(t.pattern, t.flags)
        evidence = F.replace(F.left(F.regexp_extract(text, p, 0), F.lit(120)), F.lit("\n"), F.lit(" "))
        found.append(F.when(text.rlike(p), F.struct(F.lit(t.reason).alias("reason"), evidence.alias("evidence"))))
    return F.array_compact(F.array(*found)) if found else F.array().cast(ISSUE)

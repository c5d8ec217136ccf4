"""Line gaps, keyword coverage, latest artifacts, upserts and bounded ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.html import fold


def lines(df: DataFrame, text: str, least: int = 25) -> DataFrame:
    """Distinct normalised lines of at least ``least`` characters."""
    rows = df.select(F.explode(F.split(F.col(text), "\n")).alias("line")).select(fold(F.col("line")).alias("line"))
    return rows.where(F.length("line") >= least).distinct()


def line_gap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines of one side only, with the side: a full outer join on the line."""
    a, b = left.withColumn("a", F.lit(1)), right.withColumn("b", F.lit(1))
    j = a.join(b, "line", "full_outer").where("a is null or b is null")
    return j.select("line", F.when(F.col("a").isNull(), "extra").otherwise("missing").alias("side"))


#: What instructions must say (id, phrase, why), the patterns of text
#: that a template leaves to be filled in, and the line that ends a checklist.
INSTRUCTION_SIGNALS = [
    ("abbreviations", "Abbreviations to use in workflows", "Useful for consistent shorthand and downstream parser hints."),
    ("mc_closer", "All Module Checklists (MC) must end with the following bullet", "Can become an automated template compliance check."),
    ("syllabus_migration", "D2L to Canvas Syllabus Information", "Provides deterministic migration guidance for syllabus sections."),
    ("no_retroactive_changes", "Do not retroactively revise previously approved content unless explicitly instructed.", "Important guardrail for trust and revision discipline."),
    ("module_checklist_alignment", "Module Checklist", "Should be included in alignment checks when content changes."),
]
PLACEHOLDERS = [r"\[instructor note:.*?\]", r"fill in text here", r"\[title here\]", r"\[activities or learning topics\]", r"\[assignment titles\]"]
CLOSER = "Contact your instructor with any questions or post in the Course Q&A."


def folded(text: Column) -> Column:
    """Lower case, straight quotes, collapsed white space."""
    return F.regexp_replace(F.translate(F.lower(F.trim(text)), "\u201c\u201d\u2019", "\"\"'"), r"(?U)\s+", " ")


def line_map(df: DataFrame, text: str, order: str) -> DataFrame:
    """DataFrame[key, line]: of each normalised line its first form, by ``order`` of
    the rows and place."""
    rows = df.select(F.col(order).alias("o"), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("pos", "line"))
    rows = rows.select("o", "pos", F.trim("line").alias("line")).where("line <> ''").withColumn("key", folded(F.col("line")))
    return rows.groupBy("key").agg(F.min_by("line", F.struct("o", "pos")).alias("line"))


def instruction_gap(source: DataFrame, draft: DataFrame, text: str, order: str, least: int = 25, limit: int = 40) -> DataFrame:
    """DataFrame[side, rank, line]: lines of the source that the draft lacks, and the
    other way round, of at least ``least`` characters, the first ``limit`` by key."""
    a, b = line_map(source, text, order), line_map(draft, text, order)
    out = None
    for side, x, y in (("missing", a, b), ("extra", b, a)):
        # The report shows ``limit`` lines; each task sends that many at most.
        top = x.join(y.select("key"), "key", "left_anti").where(F.length("line") >= least).orderBy("key").limit(limit)
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("key"))).select(F.lit(side).alias("side"), "rank", "line")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def critical_gaps(source: DataFrame, draft: DataFrame, text: str, signals: list[tuple[str, str, str]] = INSTRUCTION_SIGNALS) -> DataFrame:
    """DataFrame[id, phrase, rationale]: phrases that a source text holds and no draft."""

    def held(df: DataFrame, side: str) -> DataFrame:
        low = folded(F.col(text))
        return df.agg(*(F.coalesce(F.bool_or(F.contains(low, folded(F.lit(p)))), F.lit(False)).alias(f"{side}{i}") for i, (_, p, _) in enumerate(signals)))

    both = held(source, "a").crossJoin(held(draft, "b"))  # two single rows
    rows = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(p).alias("phrase"), F.lit(r).alias("rationale"), (F.col(f"a{k}") & ~F.col(f"b{k}")).alias("gap")) for k, (i, p, r) in enumerate(signals)))
    return both.select(F.explode(rows).alias("x")).where("x.gap").select("x.id", "x.phrase", "x.rationale")


def template_placeholders(df: DataFrame, text: str) -> DataFrame:
    """One row: the patterns of text to be filled in that any template text has, in
    order, and whether one has the line that ends a checklist."""
    low = folded(F.col(text))
    found = df.agg(*(F.bool_or(low.rlike(f"(?i){p}")).alias(f"p{i}") for i, p in enumerate(PLACEHOLDERS)), F.coalesce(F.bool_or(F.contains(low, folded(F.lit(CLOSER)))), F.lit(False)).alias("closer_present"))
    return found.select("closer_present", F.array_compact(F.array(*(F.when(F.col(f"p{i}"), F.lit(p)) for i, p in enumerate(PLACEHOLDERS)))).alias("placeholders"))


def policy_facts(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row: what the best practices say of titles and accordions, and the first
    lines that say so."""
    #: Phrases of each fact and of each excerpt.
    facts = {"pipes_deprecated": ["we are no longer using the bar", "no longer using the bar"], "accessible_accordion_allowed": ["accessible accordion code", "you can also now use the accessible accordion code"], "module_prefix_expected": ["module # before the name", "module 1:"]}
    excerpts = {"title_policy_excerpt": ["no longer using the bar", "naming pattern is now module 1:"], "accordion_policy_excerpt": ["accessible accordion code", "recreate content in a simplified manner"]}
    rows = df.select(F.col(order).alias("o"), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    low, whole = folded(F.col("line")), folded(F.col(text))
    has = lambda t, ps: F.coalesce(*(F.when(F.contains(t, F.lit(p)), True) for p in ps), F.lit(False))
    a = df.agg(*(F.coalesce(F.bool_or(has(whole, ps)), F.lit(False)).alias(k) for k, ps in facts.items()))
    at = F.struct("o", "pos")
    b = rows.agg(*(F.coalesce(F.min_by("line", F.when(has(low, ps), at)), F.lit("")).alias(k) for k, ps in excerpts.items()))
    return a.crossJoin(b)  # two single rows


def coverage(df: DataFrame, text: str, signals: list[tuple[str, list[str]]]) -> DataFrame:
    """How many rows hold any keyword of each signal: one pass, one row out per
    signal. Signals are configuration."""
    low = F.lower(F.col(text))
    hit = lambda words: F.coalesce(*(F.when(F.contains(low, F.lit(w)), True) for w in words), F.lit(False))
    counts = df.agg(F.count("*").alias("rows"), *(F.count(F.when(hit(ws), 1)).alias(s) for s, ws in signals))
    return counts.select("rows", F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(f"`{s}`").alias("n")) for s, _ in signals))).alias("x")).select("x.signal", "x.n", (F.col("x.n") > 0).alias("covered"), "rows")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key, by an order that leaves no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert(facts: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: changed if any was, counts summed, issues of the last."""
    return facts.groupBy(key).agg(F.bool_or("changed").alias("changed"), F.sum("count").alias("count"), F.max_by("issue", order).alias("issue"), F.count("*").alias("versions"))


def current_artifacts(artifacts: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """Artifacts at least as new as their key's baseline."""
    b = baselines.groupBy(key).agg(F.max("ts").alias("baseline_ts"))
    return artifacts.join(b, key).withColumn("is_current", F.col("ts") >= F.col("baseline_ts"))


def top_per_group(df: DataFrame, group: str, value: str, k: int, tie: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(value), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

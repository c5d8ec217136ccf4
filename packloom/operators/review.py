"""Review of converted packages: rows, summary and write-back of drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.arrow import similarity
from packloom.functions.html import compare_key, matches, plain_text
from packloom.operators import metrics

_BLOCK = r"(?is)<(?:h[1-6]|p|li)\b[^>]*>(.*?)</(?:h[1-6]|p|li)>"


def preview(text, limit: int = 6):
    """The first blocks with text, long ones cut."""
    blocks = F.filter(F.transform(matches(text, _BLOCK, 1), lambda b: plain_text(b, True)), lambda b: (b != "") & ~F.lower(b).isin("printer-friendly version", "printer friendly version"))
    return F.slice(F.transform(blocks, lambda b: F.when(F.length(b) > 220, F.concat(F.rtrim(F.left(b, F.lit(217))), F.lit("..."))).otherwise(b)), 1, limit)


def review_rows(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Page pairs (path, original, converted) with findings per path (path, manual,
    accessibility) to priority, score and what changed. Rows of pseudo-paths
    (with ``::``) have no page and fall out of the join."""
    o, c = F.col("original"), F.col("converted")
    b, a = metrics.content_metrics(o), metrics.content_metrics(c)
    keys = list(b)
    rows = pairs.select("path", *(b[k].alias(f"b_{k}") for k in keys), *(a[k].alias(f"a_{k}") for k in keys), compare_key(F.array_join(preview(o), " ")).alias("p1"), compare_key(F.array_join(preview(c), " ")).alias("p2"))
    visual = metrics.visual_audit(pairs).select("path", metrics.visual_reasons().alias("visual"))
    j = rows.join(visual, "path").join(counts, "path", "left").fillna(0, ["manual", "accessibility"])
    drift = metrics.metric_drift({k: F.col(f"b_{k}") for k in keys}, {k: F.col(f"a_{k}") for k in keys})
    j = j.withColumn("structural", drift).withColumn("similarity", F.round(similarity("p1", "p2"), 3))
    j = j.withColumn("score", metrics.review_score(F.col("manual"), F.col("accessibility"), F.size("visual"), F.size("structural"), F.col("similarity")))
    return j.select("path", metrics.review_priority(F.col("score"), F.col("manual"), F.col("accessibility")).alias("priority"), "score", "similarity", "manual", "accessibility", "visual", "structural")


def ranked(rows: DataFrame, limit: int | None = None) -> DataFrame:
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    out = rows.orderBy(rank, F.desc("score"), "path")
    return out.limit(limit) if limit else out


def review_summary(rows: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return rows.agg(F.count("*").alias("files_scanned"), n(F.col("priority") == "high").alias("high"), n(F.col("priority") == "medium").alias("medium"), n(F.col("manual") > 0).alias("with_manual"), n(F.col("accessibility") > 0).alias("with_accessibility"), n(F.size("visual") > 0).alias("with_visual"), n(F.size("structural") > 0).alias("with_drift"))


def with_body(html: Column, body: Column) -> Column:
    """A page whose body's content, up to its first end, is another one without white space
    around it; a page without a body becomes it."""
    m = r"(?is)^(.*?<body\b[^>]*>)(.*?)(</body>.*)$"
    new = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    inside = F.concat(F.lit("\n"), F.when(new != "", F.concat(new, F.lit("\n"))).otherwise(""))
    return F.when(html.rlike(m), F.concat(F.regexp_extract(html, m, 1), inside, F.regexp_extract(html, m, 3))).otherwise(new)


def apply_drafts(pages: DataFrame, drafts: DataFrame) -> DataFrame:
    """Pages (path, html) with the bodies of drafts (path, edited_body_html) in
    place, and ``status``: kept, updated, unchanged, or missing for drafts of
    pages that are not there."""
    d = drafts.select("path", F.col("edited_body_html").alias("edit"))
    j = pages.join(d, "path", "full_outer")
    h = F.col("html")
    new = with_body(h, F.col("edit"))
    status = F.when(h.isNull(), "missing").when(F.col("edit").isNull(), "kept").when(new == h, "unchanged").otherwise("updated")
    return j.select("path", F.when(F.col("edit").isNull(), h).otherwise(F.when(h.isNotNull(), new)).alias("html"), status.alias("status"))

"""Queries over measures, rankings and patterns of pages and packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from packloom.operators import corpus, findings, links, metrics, patterns, readiness, render, reports, review
from packloom.plans import registry
from packloom.plans.registry import _LIVE_SQL, _TRIGGER_SQL, _case, _pick, query
from packloom.runtime import table

_HEADS = r"heads AS (SELECT page_id, regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1) AS a, regexp_extract(html, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>', 1) AS b FROM pages)"
_ISSUES = f"{_TRIGGER_SQL.strip()}, {_HEADS}, e AS (SELECT page_id, reason FROM found UNION ALL SELECT page_id, 'Title repeated in first heading' FROM heads WHERE a = b AND regexp_replace(a, '[^A-Za-z0-9]', '', 'g') <> '')"


@query(f"WITH {_ISSUES} SELECT reason, count(*)::BIGINT AS n FROM e GROUP BY 1")
def top_reasons(spark, sf):
    """The most common findings of all pages; there are fewer than the limit."""
    return findings.top_reasons(registry._page_issues(spark, sf))


@query(f"WITH {_ISSUES}, c AS (SELECT page_id AS path, count(*)::BIGINT AS total FROM e GROUP BY 1) SELECT path, total, total AS manual FROM c ORDER BY total DESC, path LIMIT 20")
def top_files(spark, sf):
    """The pages with most findings."""
    return findings.top_files(registry._page_issues(spark, sf))


@query(f"WITH {_ISSUES} SELECT 'manual' AS type, reason, count(*)::BIGINT AS n_issues, count(DISTINCT page_id)::BIGINT AS n_files FROM e GROUP BY 2")
def reason_counts(spark, sf):
    """Findings and pages of each reason."""
    return findings.reason_counts(registry._page_issues(spark, sf))


#: Counts before and after (images, headings, frames, tables, words), and the reasons.
DRIFT_CASES = [
    ((3, 2, 0, 0, 10), (0, 2, 0, 0, 10), "Converted page removed all images from the original page."),
    ((3, 2, 0, 0, 10), (1, 2, 0, 0, 10), "Image count changed 3 -> 1."),
    ((1, 5, 1, 2, 100), (1, 3, 0, 1, 60), "Heading count changed 5 -> 3.|Embedded iframe count changed 1 -> 0.|Table count changed 2 -> 1.|Word count changed 100 -> 60."),
    ((0, 0, 0, 0, 59), (1, 1, 0, 0, 1), ""),
    ((0, 0, 0, 0, 100), (0, 1, 0, 0, 61), ""),
]


@query(f"SELECT s_suppkey, {_case('s_suppkey', [c[2] for c in DRIFT_CASES])} AS reasons FROM supplier")
def metric_drift(spark, sf):
    """Reasons why a page's content looks changed."""
    k = F.col("s_suppkey")
    names = ["image_count", "heading_count", "iframe_count", "table_count", "word_count"]
    at = lambda side: {n: _pick(k, [c[side][i] for c in DRIFT_CASES]) for i, n in enumerate(names)}
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(metrics.metric_drift(at(0), at(1)), "|").alias("reasons"))


@query("""WITH x AS (SELECT p_partkey, p_partkey % 5 AS m, p_size % 4 AS a, p_partkey % 3 AS v, p_size % 3 AS s, CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.6 ELSE 0.9 END AS q FROM part),
y AS (SELECT *, m * 4 + a * 3 + v * 2 + s + CASE WHEN q > 0 AND q < 0.55 THEN 2 WHEN q > 0 AND q < 0.72 THEN 1 ELSE 0 END AS score FROM x)
SELECT p_partkey, score::BIGINT AS score, CASE WHEN m >= 4 OR a >= 3 OR score >= 10 THEN 'high' WHEN m > 0 OR a > 0 OR score >= 4 THEN 'medium' ELSE 'low' END AS priority FROM y""")
def review_scores(spark, sf):
    """Scores and priorities of pages to be reviewed."""
    k, z = F.col("p_partkey"), F.col("p_size")
    m, a = k % 5, z % 4
    q = F.when(k % 4 == 0, 0.0).when(k % 4 == 1, 0.5).when(k % 4 == 2, 0.6).otherwise(0.9)
    score = metrics.review_score(m, a, k % 3, z % 3, q)
    return table(spark, sf, "part").select("p_partkey", score.cast("long").alias("score"), metrics.review_priority(score, m, a).alias("priority"))


#: A converted page, and what its audit says.
VISUAL_CASES = [
    ("<title>Cells</title><h2>The cells</h2>", "Converted page still contains one or more <title> tags."),
    ("<title>Cells</title><h2>Cells!</h2>", "Converted page still repeats the title in the first content block.|Converted page still contains one or more <title> tags."),
    ('<a href="/shared/Brightspace_HTML_Template/x">#</a>', "Converted page still references shared Brightspace template assets."),
    ('<hr style="height: 2px"><hr>', "Converted page still contains nonstandard divider styling."),
    ('<img src="TemplateAssets/a.png"><img src="TemplateAssets/banner-a.png"><img src="TemplateAssets/b.png" style="width: 45px">', "Converted page still contains template icons without standard sizing."),
    ("<p>#</p>", ""),
]


@query(f"SELECT s_suppkey AS path, {_case('s_suppkey', [c[1] for c in VISUAL_CASES])} AS reasons FROM supplier")
def visual_reasons(spark, sf):
    """What the visual audit says of converted pages."""
    k = F.col("s_suppkey")
    pairs = table(spark, sf, "supplier").select(k.alias("path"), F.lit("x").alias("original"), _pick(k, [c[0] for c in VISUAL_CASES]).alias("converted"))
    return metrics.visual_audit(pairs).select("path", F.array_join(metrics.visual_reasons(), "|").alias("reasons"))


@query("""SELECT s_nationkey AS package, count(*)::BIGINT AS titles, count(*) FILTER (s_suppkey % 4 = 0)::BIGINT AS with_pipe, count(*) FILTER (s_suppkey % 4 = 1)::BIGINT AS with_colon FROM supplier GROUP BY 1""")
def delimiter_stats(spark, sf):
    """Titles with bars and with colons."""
    k = F.col("s_suppkey")
    return patterns.delimiter_stats(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("package"), _pick(k, ["Quiz # | One", "Quiz #: One", "Plain #", "a|b#"]).alias("title")))


_ICON_SQL = "i AS (SELECT s_nationkey AS package, 'part ' || (s_suppkey % 6) AS heading, s_suppkey FROM supplier), f AS (SELECT package, heading, min(s_suppkey) AS k FROM i GROUP BY ALL)"


def _icons(spark, sf, names: list[str]):
    k = F.col("s_suppkey")
    page = F.concat(F.lit("<p>x</p><h3><img src='a/"), _pick(k, names), F.lit("?x=1'> Part "), (k % 6).cast("string"), F.lit("</h3><h4>no icon</h4>"))
    # All pages of a package as one text, so that the first icon of a heading is known.
    pages = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("package")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k, page.alias("p")))), lambda x: x.p), "").alias("html"))
    return patterns.icon_signatures(pages)


@query(f"WITH {_ICON_SQL} SELECT package, heading, {_case('k', ['red.png', 'blue.png', 'g.png'])} AS icon FROM f")
def icon_signatures(spark, sf):
    """The first icon of each heading of a package."""
    return _icons(spark, sf, ["Red.png", "blue.png", "G.PNG"])


@query(f"WITH {_ICON_SQL}, j AS (SELECT package, heading, {_case('k', ['red.png', 'blue.png', 'g.png'])} AS before, {_case('k', ['x.png', 'y.png'])} AS after FROM f) SELECT before, after, count(DISTINCT package)::BIGINT AS packages, min(heading) AS sample FROM j GROUP BY 1, 2 HAVING count(DISTINCT package) >= 2")
def icon_pairs(spark, sf):
    """Icons that became another one in several packages."""
    return patterns.icon_pairs(_icons(spark, sf, ["Red.png", "blue.png", "G.PNG"]), _icons(spark, sf, ["x.png", "y.png"]))


@query("""WITH r AS (SELECT p_partkey % 50 AS path, CASE p_size % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'alias' WHEN 2 THEN 'collision' WHEN 3 THEN 'unmapped' ELSE 'direct' END AS o FROM part)
SELECT count(DISTINCT path)::BIGINT AS files_scanned, count(DISTINCT path) FILTER (o IN ('collision', 'unmapped'))::BIGINT AS files_with_unresolved, count(*) FILTER (o = 'direct')::BIGINT AS mapped_direct, count(*) FILTER (o = 'alias')::BIGINT AS mapped_alias, count(*) FILTER (o IN ('direct', 'alias'))::BIGINT AS mapped_total, count(*) FILTER (o IN ('collision', 'unmapped'))::BIGINT AS unresolved_total FROM r""")
def overlay_totals(spark, sf):
    """Totals of resolved template references."""
    p = table(spark, sf, "part")
    return patterns.overlay_totals(p.select((F.col("p_partkey") % 50).alias("path"), F.lit("n").alias("name"), F.lit(1).alias("asset"), _pick(F.col("p_size"), ["direct", "alias", "collision", "unmapped", "direct"]).alias("outcome")))


#: Headings of a page, and its outline.
OUTLINE_CASES = [("<h1>a #</h1><p>x</p><h2> </h2><h3>b &amp; <b>c</b></h3>", "a #|b & c"), ("<h2>Printer-friendly version</h2><h2>z</h2>", "z"), ("<p>x</p>", ""), ("".join(f"<h2>h{i}</h2>" for i in range(12)), "|".join(f"h{i}" for i in range(8)))]


@query(f"SELECT s_suppkey, {_case('s_suppkey', [c[1] for c in OUTLINE_CASES])} AS outline FROM supplier")
def outlines(spark, sf):
    """The first headings of pages."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(patterns.outline(_pick(k, [c[0] for c in OUTLINE_CASES])), "|").alias("outline"))


@query("""SELECT p_size AS package, count(*) FILTER (p_partkey % 5 IN (0, 1, 2))::BIGINT AS assets, count(*) FILTER (p_partkey % 5 = 0)::BIGINT AS icons, count(*) FILTER (p_partkey % 5 = 1)::BIGINT AS banners, count(*) FILTER (p_partkey % 5 = 2)::BIGINT AS buttons, count(*) FILTER (p_partkey % 5 = 3)::BIGINT AS wiki_pages FROM part GROUP BY 1""")
def template_inventory(spark, sf):
    """What template packages hold."""
    k = F.col("p_partkey")
    paths = ["web/Icons/icon-#.PNG", "web/banner-#.jpg", "web/button#.svg", "wiki_content/p#.html", "web/p#.html"]
    return corpus.template_inventory(table(spark, sf, "part").select(F.col("p_size").alias("package"), _pick(k, paths).alias("path")))


@query("""WITH f AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS changed, s_suppkey % 3 AS c, s_suppkey % 4 AS m, s_suppkey % 5 AS a FROM supplier)
SELECT count(*)::BIGINT AS files, count(*) FILTER (changed)::BIGINT AS changed_files, sum(c * (c + 1) // 2)::BIGINT AS changes, sum(m)::BIGINT AS manual_issues, sum(a)::BIGINT AS accessibility_issues, count(*) FILTER (m > 0)::BIGINT AS files_with_manual_issues, count(*) FILTER (a > 0)::BIGINT AS files_with_accessibility_issues FROM f""")
def file_totals(spark, sf):
    """Totals of converted files."""
    k = F.col("s_suppkey")
    changes = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), k % 3), lambda i: i > 0), lambda i: F.struct(i.alias("count")))
    issues = lambda n: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), n), lambda i: i > 0), lambda i: F.struct(i.cast("string").alias("reason")))
    rows = table(spark, sf, "supplier").select(k.alias("path"), (k % 2 == 0).alias("changed"), changes.alias("changes"), issues(k % 4).alias("manual"), issues(k % 5).alias("accessibility"))
    return reports.file_summary(rows)


@query("""SELECT count(*)::BIGINT AS files_scanned, count(*) FILTER (s_suppkey % 3 = 0)::BIGINT AS high, count(*) FILTER (s_suppkey % 3 = 1)::BIGINT AS medium, count(*) FILTER (s_suppkey % 4 > 0)::BIGINT AS with_manual, count(*) FILTER (s_suppkey % 5 > 0)::BIGINT AS with_accessibility, count(*) FILTER (s_suppkey % 2 = 0)::BIGINT AS with_visual, count(*) FILTER (s_suppkey % 7 = 0)::BIGINT AS with_drift FROM supplier""")
def review_totals(spark, sf):
    """Totals of pages to be reviewed."""
    k = F.col("s_suppkey")
    one = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf, "supplier").select(_pick(k, ["high", "medium", "low"]).alias("priority"), (k % 4).alias("manual"), (k % 5).alias("accessibility"), one(k % 2 == 0).alias("visual"), one(k % 7 == 0).alias("structural"))
    return review.review_summary(rows)


@query("""WITH a AS (SELECT p_size % 9 AS rank, 'do ' || (p_partkey % 7) AS action FROM part), g AS (SELECT action, min(rank) AS rank FROM a GROUP BY 1) SELECT action, rank FROM g ORDER BY rank, action LIMIT 3""")
def next_steps(spark, sf):
    """The first three different actions."""
    return reports.next_steps(table(spark, sf, "part").select((F.col("p_size") % 9).alias("rank"), F.concat(F.lit("do "), (F.col("p_partkey") % 7).cast("string")).alias("action")))


@query(f"""{_LIVE_SQL}, c AS (SELECT issue_type, CASE s_suppkey % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'assignment' ELSE 'discussion' END AS content_type FROM a), n AS (SELECT 1 AS section, issue_type AS v, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 5, content_type, count(*) FROM c GROUP BY 2)
SELECT section, lpad((1000000000000 - n)::VARCHAR, 13, '0') || '|' || v AS key, 0 AS pos, '- ' || v || ': ' || n AS line FROM n UNION ALL SELECT * FROM (VALUES (0, '', 0, '## Findings By Issue Type'), (0, '', 1, ''), (3, '', 0, ''), (4, '', 0, '## Findings By Content Type'), (4, '', 1, ''), (7, '', 0, ''))""")
def findings_report(spark, sf):
    """Findings of the live audit as Markdown."""
    k = F.col("s_suppkey") % 3
    rows = registry._live(spark, sf).withColumn("content_type", F.when(k == 0, "page").when(k == 1, "assignment").otherwise("discussion"))
    return render.findings_report(links.audit_counts(rows))


_REPORT_KINDS = [readiness.CONVERSION, *readiness.KINDS]


@query(f"""WITH r AS (SELECT user_id % 400 AS package, CASE event_id % 23 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_REPORT_KINDS))} END AS kind, ts AS tm, event_id AS e FROM events),
l AS (SELECT package, kind, arg_max(e, row(tm, e::VARCHAR)) AS e, max(tm) AS tm FROM r WHERE kind IS NOT NULL GROUP BY package, kind),
i AS (SELECT package, CASE WHEN kind = 'issues_post' THEN 'issues' ELSE kind END AS kind, e, tm FROM l WHERE kind <> 'issues' OR package NOT IN (SELECT package FROM l WHERE kind = 'issues_post')),
c AS (SELECT package, tm FROM i WHERE kind = 'migration_report'),
w AS (SELECT i.package, max(e) FILTER (kind = 'migration_report') AS mig, {', '.join(f"max(e) FILTER (kind = '{k}' AND (c.tm IS NULL OR i.tm >= c.tm)) AS {k}" for k in readiness.KINDS if k != 'issues_post')} FROM i LEFT JOIN c ON c.package = i.package GROUP BY i.package),
p AS (SELECT DISTINCT package FROM r),
n AS (SELECT p.package, mig IS NOT NULL AS converted, coalesce(mig % 1000, 0) AS changes, coalesce(mig % 3, 0) AS manual, coalesce(mig % 4, 0) AS accessibility,
 CASE WHEN approval_report IS NOT NULL THEN 'approval_report' WHEN pattern_report IS NOT NULL THEN 'pattern_report' WHEN page_review IS NOT NULL THEN 'page_review' WHEN math_audit IS NOT NULL THEN 'math_audit' WHEN visual_audit IS NOT NULL THEN 'visual_audit' ELSE 'none' END AS review,
 CASE approval_report % 2 WHEN 0 THEN 'approved' WHEN 1 THEN 'review' END AS review_status, coalesce(approval_report % 101, 0) AS score, coalesce(page_review % 2, 0) AS high_pages, coalesce(pattern_report % 5, 0) AS gaps, coalesce(math_audit % 6, 0) AS math_flags,
 coalesce(issues % 2, 0) AS issues, coalesce(live_audit % 2, 0) AS findings, snapshot, page_review, approval_report FROM p LEFT JOIN w USING (package)),
s AS (SELECT *, snapshot IS NOT NULL OR issues > 0 OR findings > 0 AS imported FROM n)
SELECT package, converted, changes, manual, accessibility, review, review_status, score, high_pages, gaps, math_flags, imported, issues, findings,
 CASE WHEN approval_report IS NOT NULL AND NOT imported THEN 'import' WHEN review_status = 'approved' AND issues = 0 AND findings = 0 THEN 'done' WHEN approval_report IS NOT NULL THEN 'checklist' WHEN page_review IS NOT NULL AND high_pages > 0 THEN 'pages' WHEN converted THEN 'review' ELSE 'prepare' END AS step FROM s""")
def package_readiness(spark, sf):
    """How far packages are by the reports that there are of them."""
    e = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, _REPORT_KINDS)), (e % 23).cast("int"))
    remainders = {"changes": 1000, "manual": 3, "accessibility": 4, "score": 101, "high_priority": 2, "gaps": 5, "flags": 6, "count": 2, "findings": 2}
    numbers = F.create_map(*(x for k, m in remainders.items() for x in (F.lit(k), e % m)))
    status = F.when(e % 2 == 0, " Approved").otherwise("review")
    rows = table(spark, sf, "events").select((F.col("user_id") % 400).alias("package"), kind.alias("kind"), F.col("ts").alias("at"), e.cast("string").alias("name"), status.alias("status"), numbers.alias("numbers"))
    return readiness.readiness(rows).drop("next_step")

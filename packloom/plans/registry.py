"""Registered queries over the library's own operators, and their SQL.

The provided pages hold no images, tables, frames or lower headings, so the
detectors for these read fragments that are built by the same expression here and
in the SQL. The SQL states each result in another way where there is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions import html as H
from packloom.operators import cohort, detect, findings, manifest, metrics, practice, resolve, rules, sets
from packloom.runtime import spread, table

FLAGSHIP = "page_audit"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _case(key: str, values: list, quote: bool = True) -> str:
    """SQL that picks a value by key; # in it is the key."""
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''").replace("#", f"' || {key} || '") + "'" if quote else str(v)
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + " END"


def _pick(key: Column, values: list) -> Column:
    """The same as a column."""
    text = lambda v: F.replace(F.lit(v), F.lit("#"), key.cast("string")) if isinstance(v, str) else F.lit(v)
    out = F.when(key % len(values) == 0, text(values[0]))
    for i, v in enumerate(values[1:], 1):
        out = out.when(key % len(values) == i, text(v))
    return out


REPLACEMENTS = [
    rules.Replacement("Drop comments", r"<!--.*?-->", "", "s"),
    rules.Replacement("Decode ampersands", r"&amp;", "&"),
    rules.Replacement("Close breaks", r"<br\s*/?>", "<br />", "i"),
    rules.Replacement("Swap link quotes", r'<a href="(?P<u>[^"]*)"', r"<a href='\g<u>'"),
]
REWRITES = [rules.Rewrite("Move site", "/the", "/page/the"), rules.Rewrite("Drop track", "track(0);", "")]
TRIGGERS = [
    rules.Trigger("Legacy script blocks need review", r"<script\b[^>]*>", "i"),
    rules.Trigger("Embedded iframe needs review", r"<iframe\b", "i"),
    rules.Trigger("Navigation block", r"<nav>\s*<ul>", "i"),
    rules.Trigger("Comment left in page", r"<!--[^-]{0,200}", "s"),
    rules.Trigger("Spanish page", r'<html lang="es"', "i"),
]


@query(r"""
WITH p AS (SELECT page_id, html,
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM pages)
SELECT page_id, len(regexp_extract_all(html, '(?i)<h[1-6]\b'))::BIGINT AS heading_count, len(regexp_extract_all(html, '(?i)<img\b'))::BIGINT + (page_id % 4 = 0)::INT AS image_count,
  len(regexp_extract_all(html, '(?i)<iframe\b'))::BIGINT + (page_id % 2) AS iframe_count, len(regexp_extract_all(html, '(?i)<table\b'))::BIGINT + 2 AS table_count, len(regexp_extract_all(html, '(?i)<details\b'))::BIGINT + (page_id % 3 = 0)::INT AS accordion_count,
  len(regexp_extract_all(html, '(?i)<hr\b'))::BIGINT + 1 AS divider_count, (page_id % 4 = 0)::BIGINT AS template_icon_count,
  len(regexp_extract_all(html, '(?i)<(?:ul|ol)\b'))::BIGINT AS list_count, len(regexp_extract_all(html, '(?i)<a\b'))::BIGINT AS link_count,
  len(regexp_extract_all(plain, '[\p{L}\p{N}_\p{M}]+'))::BIGINT AS word_count
FROM p""")
def page_content_metrics(spark, sf):
    """Counts of tags and words of each page."""
    k = F.col("page_id")
    more = F.concat(F.when(k % 2 == 1, "<IFRAME>").otherwise(""), F.lit("<table><hr><table >"), F.when(k % 3 == 0, "<details>").otherwise(""), F.when(k % 4 == 0, '<img src="../TemplateAssets/a.png">').otherwise(""))
    m = metrics.content_metrics(F.concat("html", more))
    return table(spark, sf, "pages").select("page_id", *(c.alias(n) for n, c in m.items()))


@query(r"""
WITH a AS (SELECT page_id, html, len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS n1, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS h1 FROM pages),
b AS (SELECT *, len(regexp_extract_all(h1, '&amp;')) AS n2, regexp_replace(h1, '&amp;', '&', 'g') AS h2 FROM a),
c AS (SELECT *, len(regexp_extract_all(h2, '(?i)<br\s*/?>')) AS n3, regexp_replace(h2, '(?i)<br\s*/?>', '<br />', 'g') AS h3 FROM b),
d AS (SELECT *, len(regexp_extract_all(h3, '<a href="[^"]*"')) AS n4, regexp_replace(h3, '<a href="([^"]*)"', '<a href=''\1''', 'g') AS h4 FROM c),
e AS (SELECT *, len(string_split(h4, '/the')) - 1 AS n5, replace(h4, '/the', '/page/the') AS h5 FROM d),
f AS (SELECT *, len(string_split(h5, 'track(0);')) - 1 AS n6, replace(h5, 'track(0);', '') AS h6 FROM e)
SELECT page_id, md5(h6) AS digest, length(h6)::BIGINT AS n_chars, (n1 + n2 + n3 + n4 + n5 + n6)::BIGINT AS n_changes,
  ((n1 > 0)::INT + (n2 > 0)::INT + (n3 > 0)::INT + (n4 > 0)::INT + (n5 > 0)::INT + (n6 > 0)::INT)::BIGINT AS n_rules FROM f""")
def rule_rewrites(spark, sf):
    """Ordered replacements, then literal rewrites, with their counts."""
    df = rules.apply_rewrites(rules.apply_replacements(table(spark, sf, "pages"), REPLACEMENTS), REWRITES)
    total = F.aggregate("changes", F.lit(0).cast("long"), lambda a, c: a + c["count"])
    return df.select("page_id", F.md5("html").alias("digest"), F.length("html").cast("long").alias("n_chars"), total.alias("n_changes"), F.size("changes").cast("long").alias("n_rules"))


@query(r"""
WITH h AS (SELECT page_id, html, '<div class="site">Notice</div>' AS b, regexp_extract(html, '(?is)^(.*?<body[^>]*>)', 1) AS head FROM pages)
SELECT page_id, md5(CASE WHEN head <> '' THEN head || chr(10) || b || chr(10) || substr(html, length(head) + 1) ELSE b || chr(10) || html END) AS digest FROM h""")
def banner_pages(spark, sf):
    """A banner put after the body tag; the second call changes nothing."""
    b = rules.Banner(True, '<div class="site">Notice</div>')
    df = rules.apply_banner(rules.apply_banner(table(spark, sf, "pages"), b), b)
    return df.select("page_id", F.md5("html").alias("digest"))


def _page_issues(spark, sf) -> DataFrame:
    h = F.col("html")
    repeated = F.when(metrics.title_repeated(h), F.array(detect.issue("Title repeated in first heading", H.title_text(h)))).otherwise(F.array().cast(rules.ISSUE))
    pages = table(spark, sf, "pages").withColumn("path", F.col("url"))
    return findings.explode_issues(pages, "page_id", F.concat(rules.triggered(h, TRIGGERS), repeated), detect.accessibility(h))


_TRIGGER_SQL = r"""
found AS (SELECT page_id, 'Legacy script blocks need review' AS reason FROM pages WHERE regexp_matches(html, '(?i)<script\b[^>]*>')
  UNION ALL SELECT page_id, 'Embedded iframe needs review' FROM pages WHERE regexp_matches(html, '(?i)<iframe\b')
  UNION ALL SELECT page_id, 'Navigation block' FROM pages WHERE regexp_matches(html, '(?i)<nav>\s*<ul>')
  UNION ALL SELECT page_id, 'Comment left in page' FROM pages WHERE regexp_matches(html, '(?s)<!--[^-]{0,200}')
  UNION ALL SELECT page_id, 'Spanish page' FROM pages WHERE regexp_matches(html, '(?i)<html lang="es"'))"""


@query(rf"""
WITH {_TRIGGER_SQL.strip()},
t AS (SELECT page_id, trim(regexp_replace(regexp_replace(lower(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', 'and')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS a,
  trim(regexp_replace(regexp_replace(lower(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>', 1), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', 'and')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS b FROM pages),
every AS (SELECT * FROM found UNION ALL SELECT page_id, 'Title repeated in first heading' FROM t WHERE a = b AND a <> '')
SELECT 'manual' AS type, reason, count(*)::BIGINT AS n_issues, count(DISTINCT page_id)::BIGINT AS n_files FROM every GROUP BY reason""")
def page_audit(spark, sf):
    """Triggers, repeated titles and accessibility findings, counted by reason."""
    return findings.reason_counts(_page_issues(spark, sf).withColumnRenamed("page_id", "path"))


@query(rf"""
WITH {_TRIGGER_SQL.strip()} SELECT page_id, reason FROM found""")
def trigger_findings(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.explode(rules.triggered(h, TRIGGERS)).alias("x")).select("page_id", "x.reason")


@query(r"""
SELECT o_orderkey, 'Non-descriptive link text' AS reason, trim(t) AS evidence FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Click Here' WHEN 1 THEN ' here ' WHEN 2 THEN 'learn <b>more</b>' WHEN 3 THEN 'MORE' ELSE 'Order of ' || o_orderpriority END AS raw, regexp_replace(CASE o_orderkey % 5 WHEN 0 THEN 'Click Here' WHEN 1 THEN ' here ' WHEN 2 THEN 'learn <b>more</b>' WHEN 3 THEN 'MORE' ELSE 'Order of ' || o_orderpriority END, '<[^>]+>', '', 'g') AS t FROM orders) WHERE lower(trim(t)) IN ('click here', 'here', 'learn more', 'more')""")
def vague_links(spark, sf):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "Click Here").when(k == 1, " here ").when(k == 2, "learn <b>more</b>").when(k == 3, "MORE").otherwise(F.concat(F.lit("Order of "), "o_orderpriority"))
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit('<p><a href="/x">'), text, F.lit("</a></p>")).alias("html"))
    return o.select("o_orderkey", F.explode(detect.link_issues(F.col("html"))).alias("x")).select("o_orderkey", "x.reason", "x.evidence")


@query(r"""
WITH l AS (SELECT l_orderkey, (1 + (l_linenumber * 3 + l_partkey) % 6)::INT AS level, lag((1 + (l_linenumber * 3 + l_partkey) % 6)::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS before FROM lineitem)
SELECT l_orderkey, 'h' || before || ' -> h' || level AS evidence, count(*)::BIGINT AS n FROM l WHERE level - before > 1 GROUP BY ALL""")
def heading_level_jumps(spark, sf):
    """Pages of headings, one per order, whose levels come from its lines."""
    l = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", (1 + (F.col("l_linenumber") * 3 + F.col("l_partkey")) % 6).cast("int").alias("level")).alias("x"))
    page = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    tag = lambda x: F.concat(F.lit("<h"), x.level, F.lit(">t</h"), x.level, F.lit(">"))
    page = page.select("l_orderkey", F.array_join(F.transform("xs", tag), "").alias("html"))
    rows = page.select("l_orderkey", F.explode(detect.heading_jumps(F.col("html"))).alias("x"))
    return rows.groupBy("l_orderkey", "x.evidence").agg(F.count("*").alias("n"))


@query(r"""
WITH p AS (SELECT p_partkey, p_partkey % 6 AS k FROM part)
SELECT p_partkey, CASE WHEN k IN (0, 1) THEN 'Image missing alt attribute' ELSE 'Image alt attribute is empty' END AS reason FROM p WHERE k IN (0, 1, 2)
UNION ALL SELECT p_partkey, 'Table missing caption' FROM p WHERE p_partkey % 4 IN (0, 1)""")
def image_and_table_findings(spark, sf):
    """Images: no alt, alt in another attribute, empty alt, empty but presentational
    twice, good; tables without, with an empty and with a good caption."""
    k = F.col("p_partkey") % 6
    img = F.when(k == 0, '<img src="a.png">').when(k == 1, "<IMG data-x='alt' src='b'>").when(k == 2, "<img alt=' ' src=b>").when(k == 3, '<img role="presentation" alt="">').when(k == 4, "<img alt='' aria-hidden='true'>").otherwise(F.concat(F.lit('<img alt="'), "p_name", F.lit('">')))
    t = F.col("p_partkey") % 4
    tab = F.when(t == 0, "<table><tr><td>1</td></tr></table>").when(t == 1, "<table><caption><b> </b></caption></table>").when(t == 2, F.concat(F.lit("<table><CAPTION class=x>"), "p_brand", F.lit("</caption></table>"))).otherwise("")
    p = spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", F.concat(F.lit("<div>"), img, tab, F.lit("</div>")).alias("html"))
    h = F.col("html")
    return p.select("p_partkey", F.explode(F.concat(detect.image_issues(h), detect.table_issues(h))).alias("x")).select("p_partkey", "x.reason")


_STYLE_SQL = "CASE p_partkey % 8 WHEN 0 THEN 'float: left' WHEN 1 THEN 'position:ABSOLUTE; top:0' WHEN 2 THEN 'display: flex' WHEN 3 THEN 'column-count: 2; color: red' WHEN 4 THEN 'width: ' || (480 + p_size) || 'px' WHEN 5 THEN 'overflow-x:auto;z-index:3' WHEN 6 THEN 'float:left;float:none' ELSE 'color: red' END"


@query(f"""
WITH s AS (SELECT p_partkey, p_partkey % 8 AS k, 480 + p_size AS w FROM part)
SELECT p_partkey, k IN (1, 2, 3) AS breaking, k = 0 AS has_float, CASE WHEN k = 4 THEN w END::INT AS fixed_width_px, k = 5 AS has_overflow_control
FROM s WHERE k IN (0, 1, 2, 3, 5) OR (k = 4 AND w > 500)""")
def layout_css(spark, sf):
    """Inline styles that break or change a layout, from styled blocks."""
    k = F.col("p_partkey") % 8
    style = (
        F.when(k == 0, "float: left").when(k == 1, "position:ABSOLUTE; top:0").when(k == 2, "display: flex").when(k == 3, "column-count: 2; color: red")
        .when(k == 4, F.concat(F.lit("width: "), (F.lit(480) + F.col("p_size")).cast("string"), F.lit("px"))).when(k == 5, "overflow-x:auto;z-index:3").when(k == 6, "float:left;float:none").otherwise("color: red")
    )
    page = F.concat(F.lit('<p>x</p><div class="a" style="'), style, F.lit('">y</div><div class="migration-x" style="float:left"></div>'))
    p = spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", F.explode(detect.layout_elements(page)).alias("x"))
    i = F.col("x.intent")
    return p.select("p_partkey", detect.is_breaking(i).alias("breaking"), i.has_float.alias("has_float"), i.fixed_width_px.alias("fixed_width_px"), i.has_overflow_control.alias("has_overflow_control"))


@query(r"""
WITH d AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'Panopto' WHEN 1 THEN 'Canvas Studio' WHEN 2 THEN 'Kaltura' WHEN 3 THEN 'YuJa' WHEN 4 THEN 'Canvas Studio' END AS tool FROM supplier)
SELECT s_suppkey, 'LTI tool embed (' || tool || ') — verify launch URL after migration' AS reason FROM d WHERE tool IS NOT NULL
UNION ALL SELECT s_suppkey, 'LTI tool embed (Panopto) — verify launch URL after migration' FROM d WHERE s_suppkey % 6 <> 0 AND s_suppkey % 4 = 0""")
def tool_embeds(spark, sf):
    k = F.col("s_suppkey") % 6
    host = F.when(k == 0, "x.hosted.PANOPTO.com").when(k == 1, "a.instructuremedia.com").when(k == 2, "cdn.kaltura.com").when(k == 3, "my.yuja.com").when(k == 4, "studio.canvas.com").otherwise("example.org")
    frame = lambda h, a="src": F.concat(F.lit(f'<iframe {a}="https://'), h, F.lit('/e/1" width="5"></iframe>'))
    page = F.concat(frame(host), frame(host, "data-mce-src"), F.when(F.col("s_suppkey") % 4 == 0, frame(F.lit("b.panopto.com"))).otherwise(""))
    return spread(table(spark, sf, "supplier"), "s_suppkey").select("s_suppkey", F.explode(detect.tool_embeds(page)).alias("x")).select("s_suppkey", "x.reason")


@query(r"""
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Instructor Note placeholder remains in content' WHEN 1 THEN 'Template placeholder text remains in content' WHEN 2 THEN 'Legacy quiz instructions detected ("Take the Quiz")' WHEN 3 THEN 'Module Checklist closing reminder appears to be missing' END AS reason,
  CASE c_custkey % 6 WHEN 0 THEN '[Instructor Note: ...]' WHEN 1 THEN 'fill in text here' WHEN 2 THEN 'Click the "Take the Quiz" button' WHEN 3 THEN 'Contact your instructor with any questions or post in the Course Q&A.' END AS evidence
FROM customer WHERE c_custkey % 6 < 4""")
def template_placeholders(spark, sf):
    k = F.col("c_custkey") % 6
    text = (
        F.when(k == 0, "<p>[ instructor note: add]</p>").when(k == 1, "<p>Fill in text here, xx</p>").when(k == 2, '<p>Click the  "Take the Quiz" button</p>').when(k == 3, "<h2>Introduction and Checklist</h2>")
        .when(k == 4, "<h2>Introduction and Checklist</h2><li>Contact your instructor with any questions or post in the course Q&amp;A</li>").otherwise(F.concat(F.lit("<p>"), "c_name", F.lit("</p>")))
    )
    c = spread(table(spark, sf, "customer"), "c_custkey").select("c_custkey", F.explode(detect.template_issues(text, F.lit("a.html"))).alias("x"))
    return c.select("c_custkey", "x.reason", "x.evidence")


_PATHS = "'dir' || (p_partkey % 7) || '/' || chr((65 + p_partkey % 5)::INT) || '_page' || (p_partkey % 211) || '.html'"
_REFS = f"""SELECT l_orderkey, l_linenumber, CASE (l_linenumber + l_orderkey) % 6 WHEN 0 THEN {_PATHS} WHEN 1 THEN upper({_PATHS}) WHEN 2 THEN 'other/' || chr((65 + p_partkey % 5)::INT) || '_page' || (p_partkey % 211) || '.html'
 WHEN 3 THEN 'page' || (p_partkey % 211) || '.html' WHEN 4 THEN 'q/page' || (p_partkey % 400) || '.html' ELSE 'gone' || l_orderkey || '.html' END AS ref, 'dir' || (p_partkey % 3) AS page_dir FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _paths(spark, sf) -> DataFrame:
    p = F.col("p_partkey")
    path = F.concat(F.lit("dir"), (p % 7).cast("string"), F.lit("/"), F.char((p % 5) + 65), F.lit("_page"), (p % 211).cast("string"), F.lit(".html"))
    return table(spark, sf, "part").select("p_partkey", path.alias("path"))


@query(rf"""
WITH paths AS (SELECT DISTINCT {_PATHS} AS path FROM part), refs AS ({_REFS}),
idx AS (SELECT path, lower(path) AS low, lower(regexp_extract(path, '([^/]*)$', 1)) AS base, lower(regexp_extract(path, '^(.*)/[^/]*$', 1)) AS dir, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^[^_]*_(.+)$', 1)) AS tail FROM paths),
keys AS (SELECT DISTINCT ref, page_dir, lower(ref) AS low, lower(regexp_extract(ref, '([^/]*)$', 1)) AS base FROM refs),
r AS (SELECT k.ref, k.page_dir, (SELECT max(path) FROM idx WHERE path = k.ref) AS e, (SELECT min(path) FROM idx WHERE idx.low = k.low) AS f,
  (SELECT CASE WHEN count(*) = 1 THEN min(path) END FROM idx WHERE idx.base = k.base) AS b,
  (SELECT count(*) FROM idx WHERE idx.tail = k.base AND idx.dir = k.page_dir) AS nn, (SELECT min(path) FROM idx WHERE idx.tail = k.base AND idx.dir = k.page_dir) AS np,
  (SELECT count(*) FROM idx WHERE idx.tail = k.base) AS fn, (SELECT min(path) FROM idx WHERE idx.tail = k.base) AS fp FROM keys k)
SELECT l_orderkey, l_linenumber, ref, CASE WHEN e IS NOT NULL THEN 'exact' WHEN f IS NOT NULL THEN 'casefold' WHEN b IS NOT NULL THEN 'basename' WHEN nn = 1 THEN 'same_dir_tail' WHEN nn = 0 AND fn = 1 THEN 'cross_dir_tail' ELSE 'missing' END AS arm,
  CASE WHEN e IS NOT NULL THEN e WHEN f IS NOT NULL THEN f WHEN b IS NOT NULL THEN b WHEN nn = 1 THEN np WHEN nn = 0 AND fn = 1 THEN fp END AS target
FROM refs JOIN r USING (ref, page_dir)""")
def reference_resolution(spark, sf):
    """The cascade of path lookups, with references for every arm."""
    p = F.col("p_partkey")
    parts = _paths(spark, sf)
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(parts, "p_partkey")
    k = (F.col("l_linenumber") + F.col("l_orderkey")) % 6
    name = F.concat(F.char((p % 5) + 65), F.lit("_page"), (p % 211).cast("string"), F.lit(".html"))
    ref = F.when(k == 0, F.col("path")).when(k == 1, F.upper("path")).when(k == 2, F.concat(F.lit("other/"), name)).when(k == 3, F.concat(F.lit("page"), (p % 211).cast("string"), F.lit(".html"))).when(k == 4, F.concat(F.lit("q/page"), (p % 400).cast("string"), F.lit(".html"))).otherwise(F.concat(F.lit("gone"), F.col("l_orderkey").cast("string"), F.lit(".html")))
    refs = l.select("l_orderkey", "l_linenumber", ref.alias("ref"), F.concat(F.lit("dir"), (p % 3).cast("string")).alias("page_dir"))
    return resolve.resolve_paths(refs, parts.select("path").distinct()).select("l_orderkey", "l_linenumber", "ref", "arm", "target")


_ASSETS = "SELECT lower('icon' || (p_partkey % 40) || '.png') AS name, p_partkey AS id FROM part WHERE p_partkey % 40 < 20 AND (p_partkey < 40 OR p_partkey % 40 < 5)"
_ALIASES = "(VALUES ('icon25.png', 0, 'none.png'), ('icon25.png', 1, 'icon7.png'), ('icon26.png', 0, 'icon1.png'), ('icon26.png', 1, 'icon8.png'), ('icon2.png', 0, 'icon9.png'), ('icon27.png', 0, 'nil.png'))"


def _asset_query(stop_direct: bool, stop_alias: bool):
    def run(spark, sf):
        p = F.col("p_partkey")
        name = F.concat(F.lit("icon"), (p % 40).cast("string"), F.lit(".png"))
        assets = table(spark, sf, "part").where((p % 40 < 20) & ((p < 40) | (p % 40 < 5))).select(name.alias("name"), p.alias("id"))
        aliases = spark.createDataFrame([("Icon25.png", 0, "none.png"), ("icon25.png", 1, "icon7.png"), ("icon26.png", 0, "icon1.png"), ("icon26.png", 1, "icon8.png"), ("icon2.png", 0, "icon9.png"), ("icon27.png", 0, "nil.png")], "source string, pos int, target string")
        refs = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("ICON"), (F.col("s_suppkey") % 40).cast("string"), F.lit(".png")).alias("name"))
        return resolve.resolve_assets(refs, assets, aliases, stop_direct, stop_alias).select("s_suppkey", "asset", "outcome")

    return run


def _asset_sql(stop_direct: bool, stop_alias: bool) -> str:
    skip = "" if stop_alias else "WHERE i.n = 1"
    return f"""
WITH a AS ({_ASSETS}), i AS (SELECT name, count(*) AS n, min(id) AS id FROM a GROUP BY name), al(source, pos, target) AS (SELECT * FROM {_ALIASES}),
hit AS (SELECT source, arg_min(i.n, pos) AS n, arg_min(i.id, pos) AS id FROM al JOIN i ON al.target = i.name {skip} GROUP BY source),
r AS (SELECT s_suppkey, 'icon' || (s_suppkey % 40) || '.png' AS name FROM supplier),
j AS (SELECT s_suppkey, d.n AS dn, d.id AS did, h.n AS hn, h.id AS hid FROM r LEFT JOIN i d ON d.name = r.name LEFT JOIN hit h ON h.source = r.name),
o AS (SELECT *, CASE WHEN dn = 1 THEN 'direct' WHEN dn > 1 AND {stop_direct} THEN 'collision' WHEN hn IS NULL AND dn > 1 THEN 'collision' WHEN hn IS NULL THEN 'unmapped' WHEN hn > 1 THEN 'collision' ELSE 'alias' END AS outcome FROM j)
SELECT s_suppkey, CASE outcome WHEN 'direct' THEN did WHEN 'alias' THEN hid END AS asset, outcome FROM o"""


for _name, _stops in (("asset_overlay", (True, True)), ("asset_relink", (False, False)), ("asset_live_audit", (True, False))):
    QUERIES[_name] = _asset_query(*_stops)
    ORACLE[_name] = _asset_sql(*_stops)


#: What follows a part's name in the title of a target, by part.
SUFFIXES = ["", " survey", " quiz", " survey two", "s and more", " quizzes", " x"]


@query(f"""
WITH n AS (SELECT p_partkey, p_size, lower(p_name) || ' ' || p_brand AS name, lower(p_name) || ' ' || p_brand || list_extract({SUFFIXES}, 1 + p_partkey % 7) AS long FROM part),
links AS (SELECT p_partkey AS link_id, CASE WHEN p_size % 3 = 0 THEN substr(lower(name), 2) ELSE lower(name) END AS text FROM n),
t AS (SELECT lower(CASE WHEN p_size % 2 = 0 THEN 'the ' || long ELSE long END) AS key, 'u/' || p_partkey AS url FROM n),
s AS (SELECT link_id, url, CASE WHEN key = text THEN 100 WHEN key = text || ' survey' THEN 95 WHEN key = text || ' quiz' THEN 94 WHEN starts_with(key, text || ' survey') THEN 93 WHEN starts_with(key, text) THEN 90 ELSE 80 END AS score FROM links JOIN t ON contains(key, text)),
b AS (SELECT link_id, max(score) AS score FROM s GROUP BY link_id)
SELECT link_id, (SELECT max(url) FROM s WHERE s.link_id = links.link_id AND s.score = b.score) AS url, b.score::INT AS score FROM links LEFT JOIN b USING (link_id)""")
def best_link_targets(spark, sf):
    """The names of all parts against titles of all parts, on every rung."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    name = F.lower(F.concat(F.lower("p_name"), F.lit(" "), F.col("p_brand")))
    links = p.select(k.alias("link_id"), F.when(F.col("p_size") % 3 == 0, F.substring(name, 2, 1000)).otherwise(name).alias("text"))
    long = F.concat(name, F.element_at(F.array(*map(F.lit, SUFFIXES)), (k % 7 + 1).cast("int")))
    key = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("the "), long)).otherwise(long)
    return resolve.best_targets(links, p.select(key.alias("key"), F.concat(F.lit("u/"), k.cast("string")).alias("url"))).select("link_id", "url", "score")


@query(r"""
WITH u AS (SELECT lower('brand' || (l_partkey % 60)) AS name, count(*)::BIGINT AS uses FROM lineitem GROUP BY 1), a AS (SELECT DISTINCT 'brand' || p_size AS name FROM part)
SELECT u.name, uses, a.name IS NOT NULL AS available FROM u LEFT JOIN a USING (name)""")
def template_compatibility(spark, sf):
    refs = table(spark, sf, "lineitem").select(F.concat(F.lit("Brand"), (F.col("l_partkey") % 60).cast("string")).alias("name"))
    assets = table(spark, sf, "part").select(F.concat(F.lit("brand"), F.col("p_size").cast("string")).alias("name"))
    return resolve.availability(refs, assets)


_FIRST = ["<title>A &amp; #</title><h1>a and #</h1>", "<title>A</title><h1>B</h1>", "<h1>zz #</h1>"]
_BEFORE = ['<div id=a class="a card b"><DIV class=\'card\'></div></div>', "<math></math><MATH>", "", '<div class="cards">']
_AFTER = [
    '<details class="migration-accordion x"><details>', '<a href="/Shared/Brightspace_HTML_Template/a">', '<hr><HR style="Height: 2px">', '<img src="../TemplateAssets/a.png"><img style="width: 45px" src="TemplateAssets/b.png"><img src="TemplateAssets/banner-1.png">',
    "<math><annotation x encoding='WIRIS'>a</annotation></math>", "",
]
_VISUAL_SQL = rf"""p AS (SELECT page_id AS path, html || {_case('page_id', _BEFORE)} AS o, CASE WHEN page_id % 5 = 4 THEN '' ELSE {_case('page_id', _FIRST)} || {_case('page_id', _AFTER)} || CASE WHEN page_id % 2 = 0 THEN regexp_replace(html, '(?is)<title\b[^>]*>.*?</title>', '', 'g') ELSE html END END AS c FROM pages),
v AS (SELECT path, o <> '' AS original_exists, c <> '' AS converted_exists, c <> '' AND path % 3 = 0 AS duplicate_title_first_block, len(regexp_extract_all(o, '(?i)<div\b[^>]*class\s*=\s*["''][^"'']*\bcard\b[^"'']*["''][^>]*>'))::BIGINT AS original_accordion_cards,
 len(regexp_extract_all(c, '(?i)<details\b[^>]*class\s*=\s*["''][^"'']*\bmigration-accordion\b[^"'']*["''][^>]*>'))::BIGINT AS converted_details_blocks, len(regexp_extract_all(lower(c), '/shared/brightspace_html_template/'))::BIGINT AS converted_shared_template_refs, len(regexp_extract_all(c, '(?i)<title\b'))::BIGINT AS converted_title_tags,
 len(list_filter(regexp_extract_all(c, '(?i)<hr\b[^>]*>'), lambda x: NOT contains(lower(x), 'height: 2px')))::BIGINT AS converted_hr_nonstandard,
 len(list_filter(regexp_extract_all(c, '(?i)<img\b[^>]*src\s*=\s*["''][^"'']*templateassets/[^"'']+["''][^>]*>'), lambda x: NOT regexp_matches(lower(x), 'banner-|footer\.png|course-card\.png|width: 24px|width: 45px|width: 72px')))::BIGINT AS converted_template_icons_missing_size_style,
 len(regexp_extract_all(o, '(?i)<math\b'))::BIGINT AS original_mathml_count, len(regexp_extract_all(c, '(?i)<math\b'))::BIGINT AS converted_mathml_count, len(regexp_extract_all(c, '(?i)<annotation\b[^>]*\bencoding\s*=\s*["'']wiris["'']'))::BIGINT AS converted_wiris_annotation_count FROM p)"""


def _visual(spark, sf) -> DataFrame:
    """Pages against a conversion that drops every second title and every fifth page."""
    k = F.col("path")
    p = table(spark, sf, "pages").select(F.col("page_id").alias("path"), "html")
    html = F.when(k % 2 == 0, F.regexp_replace("html", r"(?is)<title\b[^>]*>.*?</title>", "")).otherwise(F.col("html"))
    after = p.where(k % 5 != 4).withColumn("html", F.concat(_pick(k, _FIRST), _pick(k, _AFTER), html))
    return metrics.visual_audit(metrics.pair_versions(p.withColumn("html", F.concat("html", _pick(k, _BEFORE))), after))


@query(f"WITH {_VISUAL_SQL} SELECT * FROM v")
def before_after_audit(spark, sf):
    """What a conversion left or changed of each page."""
    return _visual(spark, sf)


@query()
def page_drift(spark, sf):
    """Drift reasons and review priority of pages whose lists are cut out."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("path"), "html")
    after = p.withColumn("html", F.regexp_replace("html", r"(?is)<(p|article)\b[^>]*>.*?</\1>", ""))
    pair = metrics.pair_versions(p, after)
    b, a = metrics.content_metrics(F.col("original")), metrics.content_metrics(F.col("converted"))
    keys = list(b)
    both = pair.select("path", *(b[k].alias(f"b_{k}") for k in keys), *(a[k].alias(f"a_{k}") for k in keys))
    drift = metrics.metric_drift({k: F.col(f"b_{k}") for k in keys}, {k: F.col(f"a_{k}") for k in keys})
    n = F.size("reasons")
    score = metrics.review_score(F.lit(0), F.lit(0), F.lit(0), n, F.lit(1.0))
    return both.withColumn("reasons", drift).select("path", F.array_join("reasons", " ").alias("reasons"), metrics.review_priority(score, F.lit(0), F.lit(0)).alias("priority"))


@query(r"""
SELECT sha256(trim(regexp_replace(lower(trim(text)), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS fingerprint, count(*)::BIGINT AS n, min(doc_id) AS first_row, (count(*) - 1)::BIGINT AS excess FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark, sf):
    return practice.duplicates(table(spark, sf, "documents"), practice.fingerprint("text"), "doc_id")


@query(r"""
SELECT 'user ' || user_id AS source_key, count(*)::BIGINT AS n_rows, count(DISTINCT event_type)::BIGINT AS n_advice FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1""")
def practice_conflicts(spark, sf):
    e = table(spark, sf, "events")
    return practice.conflicts(e, F.concat(F.lit(" User  "), F.col("user_id").cast("string")), F.col("event_type"))


@query()
def fuzzy_practice_pairs(spark, sf):
    """Near-equal benchmark rows; each item stands beside an edited copy of itself."""
    b = table(spark, sf, "benchmark")
    rows = b.select((F.col("item_id") * 2).alias("row"), "text").unionByName(b.select((F.col("item_id") * 2 + 1).alias("row"), F.concat(F.lit("x"), F.expr("substring(text, 2)"), F.lit(" end")).alias("text")))
    return practice.fuzzy_pairs(rows, "row", F.col("text"), practice.fingerprint("text"))


_LINES = r"SELECT DISTINCT trim(regexp_replace(lower(trim(line)), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM {t}) WHERE length(trim(regexp_replace(lower(trim(line)), '[ \t\n\x0B\f\r]+', ' ', 'g'))) >= 25"


@query(f"""
WITH a AS ({_LINES.format(t="(SELECT text FROM documents WHERE lang = 'en')")}), b AS ({_LINES.format(t="(SELECT text FROM documents WHERE source = 'src1' OR source = 'src0')")})
SELECT side, count(*)::BIGINT AS n FROM (SELECT 'missing' AS side, line FROM (SELECT line FROM a EXCEPT SELECT line FROM b) UNION ALL SELECT 'extra', line FROM (SELECT line FROM b EXCEPT SELECT line FROM a)) GROUP BY side""")
def instruction_gap(spark, sf):
    """Lines that one of two sets of texts has and the other has not."""
    d = table(spark, sf, "documents")
    gap = sets.line_gap(sets.lines(d.where("lang = 'en'"), "text"), sets.lines(d.where("source in ('src0', 'src1')"), "text"))
    return gap.groupBy("side").agg(F.count("*").alias("n"))


SIGNALS = [("license", ["license", "copyright"]), ("contact", ["@mail", "phone"]), ("secret", ["token", "password"]), ("absent", ["zzzz-not-there"])]


@query("""
WITH d AS (SELECT lower(text) AS t FROM documents), s(signal, n) AS (
  SELECT 'license', count(*) FILTER (contains(t, 'license') OR contains(t, 'copyright')) FROM d UNION ALL SELECT 'contact', count(*) FILTER (contains(t, '@mail') OR contains(t, 'phone')) FROM d
  UNION ALL SELECT 'secret', count(*) FILTER (contains(t, 'token') OR contains(t, 'password')) FROM d UNION ALL SELECT 'absent', count(*) FILTER (contains(t, 'zzzz-not-there')) FROM d)
SELECT signal, n::BIGINT AS n, n > 0 AS covered, (SELECT count(*) FROM d)::BIGINT AS "rows" FROM s""")
def keyword_coverage(spark, sf):
    return sets.coverage(table(spark, sf, "documents"), "text", SIGNALS)


#: Import issues: description, priority, category, owner.
IMPORT_CASES = [
    ("We couldn't determine the correct answers #", "P1", "quiz_answer_key", "Faculty/ID"), ("Missing links found in imported content - Wiki Page Body", "P1", "missing_page_link", "ID"),
    ("Missing links found in imported content - Announcement Message", "P2", "missing_announcement_link", "ID"), ("x missing links found in imported content - assignment description", "P1", "missing_assignment_link", "ID"),
    ("Missing links found in imported content - Assessment Question question_text", "P1", "missing_assessment_question_link", "Faculty/ID"), ("Import Error: Module Item - #", "P1", "module_item_import_error", "ID"),
    ("Import Error: Quiz - #", "P1", "quiz_import_error", "Faculty/ID"), ("An import error: quiz - #", "P2", "canvas_import_warning", "ID"), ("", "P2", "canvas_import_warning", "ID"),
]
PRACTICE_CASES = ["item_bank_sharing", "question_library_rebuild", "rubric_use_for_grading", "studio_video_workflow", " Mobile_View_Review", "other"]


def _reference_items(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    gaps = s.select(F.concat(F.lit("g"), k.cast("string")).alias("id"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit(" phrase "), k.cast("string"))).alias("phrase"), F.col("s_name").alias("rationale"))
    practices = s.select(_pick(k, PRACTICE_CASES).alias("id"), F.col("s_name").alias("label"), (k % 4 < 2).alias("action_needed"))
    template = spark.range(1).select(F.lit(False).alias("closer_present"), F.array(*(F.lit(f"p{i}") for i in range(7))).alias("placeholders"))
    return findings.reference_checklist(gaps, practices, template)


def _checklist(spark, sf) -> DataFrame:
    manual = findings.review_checklist(_page_issues(spark, sf).withColumn("path", F.format_string("%08d", "path")))
    k = F.col("o_orderkey")
    imports = table(spark, sf, "orders").select(_pick(k, [c[0] for c in IMPORT_CASES]).alias("description"), k.cast("string").alias("reference"))
    return findings.checklist(manual, findings.import_checklist(imports), _reference_items(spark, sf), findings.standard_tasks(spark))


def _values(rows: list[tuple]) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


_IMPORT_ACTIONS = {c: a for _, _, c, _, a in findings.IMPORT_LADDER} | {"canvas_import_warning": findings.IMPORT_DEFAULT[3]}
_PRACTICES = {i: (p, o, a) for i, p, o, a in findings.PRACTICE_LADDER}
_CHECKLIST_SQL = rf"""{_TRIGGER_SQL.strip()}, heads AS (SELECT page_id, regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1) AS a, regexp_extract(html, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>', 1) AS b FROM pages),
every AS (SELECT page_id, reason FROM found UNION ALL SELECT page_id, 'Title repeated in first heading' FROM heads WHERE a = b AND regexp_replace(a, '[^A-Za-z0-9]', '', 'g') <> ''),
g AS (SELECT reason, count(*) AS n, list_sort(list(format('{{:08d}}', page_id)))[1:3] AS f FROM every GROUP BY reason),
rv(mark, priority, category, owner, action) AS {_values([(r[0].lower(), *r[1:]) for r in findings.REVIEW_LADDER[:2]])},
m AS (SELECT coalesce(rv.priority, 'P2') AS priority, 'manual_review' AS source, coalesce(rv.category, 'manual_review_item') AS category, coalesce(rv.owner, 'ID') AS owner, reason AS description, coalesce(rv.action, 'Review and resolve this migration finding.') AS action, n::BIGINT AS count, 'manual-review.csv | sample files: ' || array_to_string(f, ', ') AS reference FROM g LEFT JOIN rv ON contains(lower(reason), mark)),
ic(i, description, priority, category, owner, action) AS {_values([(i, d, p, c, o, _IMPORT_ACTIONS[c]) for i, (d, p, c, o) in enumerate(IMPORT_CASES)])},
i AS (SELECT priority, 'canvas_import' AS source, category, owner, CASE WHEN description = '' THEN 'Canvas import warning' ELSE replace(description, '#', o_orderkey::VARCHAR) END AS description, action, 1::BIGINT AS count, o_orderkey::VARCHAR AS reference FROM orders JOIN ic ON o_orderkey % {len(IMPORT_CASES)} = i),
pc(i, id, priority, owner, action) AS {_values([(i, c, *_PRACTICES.get(c.strip().lower(), findings.PRACTICE_DEFAULT)) for i, c in enumerate(PRACTICE_CASES)])},
r AS (SELECT 'P2', 'reference_audit', 'reference_instruction_gap:g' || s_suppkey, 'ID Lead', 'phrase ' || s_suppkey, '{findings.PHRASE_ACTION}', 1::BIGINT, s_name FROM supplier WHERE s_suppkey % 3 <> 0
  UNION ALL SELECT priority, 'reference_audit', 'reference_best_practice_gap:' || id, owner, s_name, action, 1::BIGINT, 'reference-audit.json' FROM supplier JOIN pc ON s_suppkey % {len(PRACTICE_CASES)} = i WHERE s_suppkey % 4 < 2
  UNION ALL SELECT * FROM {_values([(p, 'reference_audit', c, o, d, a, 1, r) for (p, c, o, d, a), r in ((findings.CLOSER_ITEM, 'reference-audit.json'), (findings.PLACEHOLDER_ITEM, 'p0, p1, p2, p3, p4'))])}),
a AS (SELECT * FROM m UNION ALL SELECT * FROM i UNION ALL SELECT * FROM r UNION ALL SELECT * FROM {_values([('P2', 'standard_migration', c, o, d, x, 1, '') for c, o, d, x in findings.STANDARD_TASKS])})"""


@query(f"""WITH {_CHECKLIST_SQL}
SELECT priority AS value, 'priority' AS kind, count(*)::BIGINT AS n FROM a GROUP BY 1 UNION ALL SELECT source, 'source', count(*)::BIGINT FROM a GROUP BY 1 UNION ALL SELECT category, 'category', count(*)::BIGINT FROM a GROUP BY 1""")
def checklist_counts(spark, sf):
    """The checklist of all sources, counted by priority, source and category."""
    return findings.checklist_counts(_checklist(spark, sf)).select("value", "kind", "n")


@query(f"WITH {_CHECKLIST_SQL} SELECT *, 'todo' AS status, '' AS notes FROM a")
def fix_checklist(spark, sf):
    """The checklist of all four sources, as a sheet."""
    return findings.checklist_rows(_checklist(spark, sf))


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_artifact(spark, sf):
    return sets.latest(table(spark, sf, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("event_id", "user_id", "event_type")


@query("""
SELECT user_id, bool_or(value > 50) AS changed, sum(1 + event_id % 3)::BIGINT AS count, arg_max(event_type, event_id) AS issue, count(*)::BIGINT AS versions FROM events GROUP BY user_id""")
def upsert_by_key(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("value") > 50).alias("changed"), (1 + F.col("event_id") % 3).alias("count"), F.col("event_type").alias("issue"), "event_id")
    return sets.upsert(e, "user_id", "event_id")


@query("""
WITH b AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT event_id, ts >= t AS is_current FROM events JOIN b USING (user_id) WHERE event_type = 'view'""")
def artifact_currency(spark, sf):
    e = table(spark, sf, "events")
    return sets.current_artifacts(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id").select("event_id", "is_current")


@query("""
SELECT l_suppkey, l_partkey, n, rank FROM (SELECT l_suppkey, l_partkey, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey)::INT AS rank FROM lineitem GROUP BY 1, 2) WHERE rank <= 20""")
def top_references_per_course(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return sets.top_per_group(n, "l_suppkey", "n", 20, "l_partkey").select("l_suppkey", "l_partkey", "n", "rank")


_TITLES = """SELECT c_nationkey AS package, CASE o_orderkey % 4 WHEN 0 THEN 'module' WHEN 1 THEN 'page' WHEN 2 THEN 'assignment' ELSE 'discussion' END AS kind,
CASE o_orderkey % 11 WHEN 0 THEN 'Module ' || (o_orderkey % 9) WHEN 1 THEN 'Topic 0' || (o_orderkey % 7) || ' | Start' WHEN 2 THEN 'Start Here' WHEN 3 THEN 'Introduction and Objectives' WHEN 4 THEN 'Introduction and Checklist' WHEN 5 THEN 'Learning Activities' WHEN 6 THEN 'Help Discussion' WHEN 7 THEN 'Course Overview' WHEN 8 THEN 'Do Not Publish' ELSE o_orderpriority END AS title
FROM orders JOIN customer ON o_custkey = c_custkey"""


def _titles(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "module").when(k % 4 == 1, "page").when(k % 4 == 2, "assignment").otherwise("discussion")
    t = F.when(k % 11 == 0, F.concat(F.lit("Module "), (k % 9).cast("string"))).when(k % 11 == 1, F.concat(F.lit("Topic 0"), (k % 7).cast("string"), F.lit(" | Start")))
    for i, s in enumerate(["Start Here", "Introduction and Objectives", "Introduction and Checklist", "Learning Activities", "Help Discussion", "Course Overview", "Do Not Publish"]):
        t = t.when(k % 11 == i + 2, s)
    return o.select(F.col("c_nationkey").alias("package"), kind.alias("kind"), t.otherwise(F.col("o_orderpriority")).alias("title"))


def _profiles(spark, sf) -> DataFrame:
    f = cohort.snapshot_features(_titles(spark, sf))
    return f.withColumn("cohort", cohort.structure_cohort()).withColumn("issue_total", F.col("module_count") % 7)


_FEATURES = f"""t AS ({_TITLES}), f AS (SELECT package, count(*) FILTER (kind = 'module') AS mc, count(*) FILTER (kind = 'page') AS pc, count(*) FILTER (kind = 'assignment') AS ac, count(*) FILTER (kind = 'discussion') AS dc,
 count(*) FILTER (kind = 'module' AND title LIKE 'Module %') AS ms, count(*) FILTER (kind = 'module' AND title LIKE 'Topic %') AS ts, count(*) FILTER (kind = 'module' AND title = 'Start Here') AS sh, count(*) FILTER (kind = 'module' AND title = 'Do Not Publish') AS im,
 count(*) FILTER (kind = 'module' AND title = 'Help Discussion') AS hd, count(*) FILTER (kind = 'module' AND title = 'Course Overview') AS ov, count(*) FILTER (kind = 'page' AND title = 'Introduction and Objectives') AS io,
 count(*) FILTER (kind = 'page' AND title = 'Introduction and Checklist') AS ic, count(*) FILTER (kind = 'page' AND title = 'Learning Activities') AS la FROM t GROUP BY package),
p AS (SELECT *, format('{{:.3f}}', ms / greatest(mc, 1))::DOUBLE AS mr, format('{{:.3f}}', ts / greatest(mc, 1))::DOUBLE AS tr, mc % 7 AS iss, CASE WHEN ms >= 4 AND ic >= 2 AND la >= 2 THEN 'template-module' WHEN ts >= 4 THEN 'topic-sequence' WHEN hd > 0 OR ov > 0 OR io > ic THEN 'overview-objectives' ELSE 'hybrid' END AS cohort FROM f)"""


_FEATURE_COLUMNS = {
    "module_count": "mc", "page_count": "pc", "assignment_count": "ac", "discussion_count": "dc", "module_style_count": "ms", "topic_style_count": "ts", "start_here_modules": "sh", "instructor_modules": "im", "help_discussion_modules": "hd",
    "overview_modules": "ov", "intro_objectives_pages": "io", "intro_checklist_pages": "ic", "learning_activities_pages": "la", "module_style_ratio": "mr", "topic_style_ratio": "tr", "issue_total": "iss",
}


@query(f"WITH {_FEATURES} SELECT package, {', '.join(f'{b} AS {a}' for a, b in _FEATURE_COLUMNS.items())}, cohort FROM p")
def package_features(spark, sf):
    """Features of packages and their cohorts."""
    return _profiles(spark, sf).select("package", *_FEATURE_COLUMNS, "cohort")


_AGREED = """count(*)::BIGINT AS reference_courses, CASE WHEN sum(ts) > sum(ms) THEN 'topic' WHEN sum(ms) = 0 AND sum(ts) = 0 THEN 'neutral' ELSE 'module' END AS preferred_module_style,
 CASE WHEN sum(io) > sum(ic) THEN 'objectives' ELSE 'checklist' END AS preferred_intro_style, median(pc)::DOUBLE AS median_pages, median(mc)::DOUBLE AS median_modules, median(ac)::DOUBLE AS median_assignments, median(iss)::DOUBLE AS median_post_import_issues,
 format('{:.3f}', avg(CASE WHEN sh > 0 THEN 1.0 ELSE 0.0 END))::DOUBLE AS start_here_presence_rate, format('{:.3f}', avg(CASE WHEN im > 0 THEN 1.0 ELSE 0.0 END))::DOUBLE AS instructor_module_presence_rate, format('{:.3f}', avg(CASE WHEN la > 0 THEN 1.0 ELSE 0.0 END))::DOUBLE AS learning_activities_presence_rate"""


@query(f"WITH {_FEATURES} SELECT cohort, {_AGREED} FROM p GROUP BY cohort")
def cohort_consensus(spark, sf):
    """What the packages of a cohort agree on."""
    return cohort.consensus(_profiles(spark, sf))


#: Packages by customer and status of order: many, in cohorts of one, two and more; the
#: profiles lack some of them, and whole cohorts.
_MANY = """t AS (SELECT 'c' || lpad((o_custkey % 400)::VARCHAR, 4, '0') AS package, CASE o_orderkey % 4 WHEN 0 THEN 'module' WHEN 1 THEN 'page' WHEN 2 THEN 'assignment' ELSE 'discussion' END AS kind, title FROM orders JOIN (SELECT o_orderkey, x.title FROM (SELECT o_orderkey, CASE (o_orderkey // 4) % 6 WHEN 0 THEN 'Module 1' WHEN 1 THEN 'Topic 1 | a' WHEN 2 THEN 'Start Here' WHEN 3 THEN 'Introduction and Objectives' WHEN 4 THEN 'Introduction and Checklist' ELSE 'Learning Activities' END AS title FROM orders) x) USING (o_orderkey)),
f AS (SELECT package, count(*) FILTER (kind = 'module') AS mc, count(*) FILTER (kind = 'page') AS pc, count(*) FILTER (kind = 'assignment') AS ac, count(*) FILTER (kind = 'discussion') AS dc, count(*) FILTER (kind = 'module' AND title = 'Module 1') AS ms, count(*) FILTER (kind = 'module' AND title LIKE 'Topic%') AS ts,
 count(*) FILTER (kind = 'module' AND title = 'Start Here') AS sh, 0 AS im, 0 AS hd, 0 AS ov, count(*) FILTER (kind = 'page' AND title = 'Introduction and Objectives') AS io, count(*) FILTER (kind = 'page' AND title = 'Introduction and Checklist') AS ic, count(*) FILTER (kind = 'page' AND title = 'Learning Activities') AS la, substr(package, 2)::INT AS i FROM t GROUP BY package),
p AS (SELECT *, format('{:.3f}', ms / greatest(mc, 1))::DOUBLE AS mr, format('{:.3f}', ts / greatest(mc, 1))::DOUBLE AS tr, mc % 7 AS iss, CASE WHEN i % 40 = 0 THEN 'one-' || i WHEN i % 40 < 3 THEN 'two-' || i // 40 WHEN i % 40 < 6 THEN 'three-' || i // 40 ELSE 'k' || i % 5 END AS cohort FROM f)"""


def _many(spark, sf) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "module").when(k % 4 == 1, "page").when(k % 4 == 2, "assignment").otherwise("discussion")
    names = ["Module 1", "Topic 1 | a", "Start Here", "Introduction and Objectives", "Introduction and Checklist", "Learning Activities"]
    title = F.element_at(F.array(*map(F.lit, names)), (F.floor(k / 4) % 6 + 1).cast("int"))
    titles = o.select(F.concat(F.lit("c"), F.lpad((F.col("o_custkey") % 400).cast("string"), 4, "0")).alias("package"), kind.alias("kind"), title.alias("title"))
    i = F.substring("package", 2, 9).cast("int")
    group = lambda name: F.concat(F.lit(name), F.floor(i / 40).cast("string"))
    named = F.when(i % 40 == 0, F.concat(F.lit("one-"), i.cast("string"))).when(i % 40 < 3, group("two-")).when(i % 40 < 6, group("three-")).otherwise(F.concat(F.lit("k"), (i % 5).cast("string")))
    return cohort.snapshot_features(titles).withColumn("cohort", named).withColumn("issue_total", F.col("module_count") % 7)


@query(f"""WITH {_MANY}, r AS (SELECT * FROM p WHERE cohort <> 'k3' AND i % 11 <> 0),
o AS (SELECT x.package, count(*) AS n FROM p x JOIN r ON r.package <> x.package AND r.cohort = x.cohort GROUP BY x.package),
j AS (SELECT x.package AS current, r.* FROM p x LEFT JOIN o ON o.package = x.package JOIN r ON r.package <> x.package AND (o.n IS NULL OR r.cohort = x.cohort))
SELECT current AS package, arg_min(cohort, package) AS cohort, {_AGREED} FROM j GROUP BY current""")
def consensus_of_others(spark, sf):
    """What the profiles of other packages agree on, for each package."""
    p = _many(spark, sf)
    return cohort.consensus_of_others(p, p.where((F.col("cohort") != "k3") & (F.substring("package", 2, 9).cast("int") % 11 != 0)))


_D = lambda a: f"abs(x.{a} - y.{a}) / greatest(abs(x.{a}), abs(y.{a}), 1.0)"


@query(f"""WITH {_FEATURES}, s AS (SELECT x.package AS query, y.package AS reference, format('{{:.1f}}', greatest(100.0 - CASE WHEN x.cohort <> y.cohort THEN 25.0 ELSE 0.0 END - 14.0 * {_D('mc')} - 14.0 * {_D('pc')} - 8.0 * {_D('ac')} - 4.0 * {_D('dc')} - 8.0 * {_D('mr')} - 8.0 * {_D('tr')} - 6.0 * {_D('ic')} - 6.0 * {_D('io')} - 6.0 * {_D('la')}
 - 3.0 * ((x.sh > 0) <> (y.sh > 0))::INT - 3.0 * ((x.im > 0) <> (y.im > 0))::INT - 3.0 * ((x.hd > 0) <> (y.hd > 0))::INT - 3.0 * ((x.ov > 0) <> (y.ov > 0))::INT - 8.0 * {_D('iss')}, 0.0))::DOUBLE AS score FROM p x JOIN p y ON x.package <> y.package)
SELECT query, rank, reference, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, reference)::INT AS rank FROM s) WHERE rank <= 3""")
def nearest_packages(spark, sf):
    p = _profiles(spark, sf)
    return cohort.nearest(p, p)


@query(f"""WITH {_MANY}, s AS (SELECT x.package AS query, y.package AS reference, format('{{:.1f}}', greatest(100.0 - CASE WHEN x.cohort <> y.cohort THEN 25.0 ELSE 0.0 END - 14.0 * {_D('mc')} - 14.0 * {_D('pc')} - 8.0 * {_D('ac')} - 4.0 * {_D('dc')} - 8.0 * {_D('mr')} - 8.0 * {_D('tr')} - 6.0 * {_D('ic')} - 6.0 * {_D('io')} - 6.0 * {_D('la')}
 - 3.0 * ((x.sh > 0) <> (y.sh > 0))::INT - 8.0 * {_D('iss')}, 0.0))::DOUBLE AS score FROM p x JOIN p y ON x.package <> y.package)
SELECT query, rank, reference, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, reference)::INT AS rank FROM s) WHERE rank <= 5""")
def nearest_of_many(spark, sf):
    """The five most similar packages of each of some hundreds."""
    p = _many(spark, sf)
    return cohort.nearest(p, p, k=5)


_GATE_COUNTS = {c: (i + 2, i % 3) for i, c in enumerate(cohort.COUNTS)}


def _current(spark, sf) -> DataFrame:
    p = _profiles(spark, sf)
    k = F.col("package")
    counts = {c: F.when(k % m == 0, k % 4).otherwise(0) if r else F.when(k % m == 1, 1).otherwise(0) for c, (m, r) in _GATE_COUNTS.items()}
    return p.withColumns(counts | {c: k % (i + 2) > 0 for i, c in enumerate(cohort.EVIDENCE)})


@query(f"""WITH {_FEATURES}, o AS (SELECT x.package, count(*) AS n FROM p x JOIN p r ON r.package <> x.package AND r.cohort = x.cohort GROUP BY x.package),
c AS (SELECT x.package, CASE WHEN sum(r.ts) > sum(r.ms) THEN 'topic' WHEN sum(r.ms) = 0 AND sum(r.ts) = 0 THEN 'neutral' ELSE 'module' END AS m, CASE WHEN sum(r.io) > sum(r.ic) THEN 'o' ELSE 'c' END AS i
 FROM p x LEFT JOIN o ON o.package = x.package JOIN p r ON r.package <> x.package AND (o.n IS NULL OR r.cohort = x.cohort) GROUP BY x.package),
x AS (SELECT *, {', '.join(f"CASE WHEN package % {m} = {0 if r else 1} THEN {'package % 4' if r else '1'} ELSE 0 END AS {c}" for c, (m, r) in _GATE_COUNTS.items())}, {', '.join(f'package % {i + 2} > 0 AS {c}' for i, c in enumerate(cohort.EVIDENCE))} FROM p JOIN c USING (package)),
y AS (SELECT *, CASE m WHEN 'module' THEN ms >= ts WHEN 'topic' THEN ts >= ms ELSE true END AND CASE i WHEN 'c' THEN ic >= io ELSE io >= ic END AS ok, post_import_issues + pre_import_issues + quiz_key_warnings > 0 OR has_live AS seen FROM x),
g AS (SELECT package, 'structure-conventions' AS gate, CASE WHEN has_snapshot AND ok THEN 'approved' WHEN has_snapshot OR has_source THEN 'review' ELSE 'attention' END AS status FROM y
 UNION ALL SELECT package, 'visual-template-fidelity', CASE WHEN {' + '.join(cohort.VISUAL)} + template_unresolved = 0 THEN 'approved' WHEN has_visual THEN 'review' ELSE 'attention' END FROM y
 UNION ALL SELECT package, 'post-import-quality', CASE WHEN seen AND missing_page_links = 0 AND post_import_issues IN (0, quiz_key_warnings) AND live_findings <= 4 THEN 'approved' WHEN seen THEN 'review' ELSE 'attention' END FROM y
 UNION ALL SELECT package, 'manual-cleanup-load', CASE WHEN manual_issues = 0 AND accessibility_issues = 0 THEN 'approved' ELSE 'review' END FROM y),
v AS (SELECT package, sum(CASE status WHEN 'approved' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) AS n, count(*) FILTER (status = 'attention') AS a, count(*) FILTER (status = 'review') AS r FROM g GROUP BY package)
SELECT package, gate, status, [0, 12, 25, 38, 50, 62, 75, 88, 100][n::INT + 1]::BIGINT AS score, CASE WHEN a > 0 THEN 'attention' WHEN r > 0 THEN 'review' ELSE 'approved' END AS overall FROM g JOIN v USING (package)""")
def approval_gates(spark, sf):
    """Four gates of every package, its score and its status."""
    p = _profiles(spark, sf)
    g = cohort.gates(_current(spark, sf), cohort.consensus_of_others(p, p))
    return g.join(cohort.approval_score(g), "package").select("package", "gate", "status", "score", "overall")


#: Titles of items and what they become.
TITLE_CASES = [
    ("Topic 0# | Start", "Module #: Start"), ("Topic# - A - b", "Module #: A - b"), ("topic 7 : x", "Module 7: x"), ("Topic # Start", "Topic # Start"), ("A Topic # | b", "A Topic # | b"),
    ("Quiz # | One", "Quiz #: One"), ("Quiz: # | One | Two", "Quiz #: One Two"), ("  Syllabus  |  Part #", "Syllabus: Part #"), ("Module # | Name", "Module # | Name"), ("Unit # | x", "Unit # | x"),
    ("Survey | #", "Survey: #"), ("Grading   Information -| #", "Grading Information: #"), ("Quiz # |", "Quiz # |"), ("| Quiz | #", "Quiz: #"), ("Re-view | #", "Review: #".replace("Review", "Re-view")), ("Plain #", "Plain #"),
    ("Preparing Your Course | #", "Preparing Your Course: #"), ("Start Here | : # -", "Start Here: #"), ("Lab | #", "Lab | #"), ("Exams & more | #", "Exams & more: #"),
]


@query(f"SELECT p_partkey, {_case('p_partkey', [b for _, b in TITLE_CASES])} AS title FROM part")
def title_delimiters(spark, sf):
    """Titles with topic numbers and bars in the template's wording."""
    k = F.col("p_partkey")
    t = manifest.normal_delimiters(manifest.topic_to_module(_pick(k, [a for a, _ in TITLE_CASES])))
    return table(spark, sf, "part").select("p_partkey", t.alias("title"))


#: Children of modules: title, title without bars, group and title in a numbered
#: module (no group: the child goes).
CHILD_CASES = [
    ("Overview", "Overview", None, None), ("Introduction and Objectives", "Introduction and Objectives", 0, "Module #: Introduction and Checklist"), ("Lesson | Cells", "Lesson: Cells", 0, "Module #: Lesson Cells"),
    ("Quiz - One", "Quiz - One", 1, "Quiz: One"), ("Unit Review", "Unit Review", 2, "Module #: Review"), ("Learning Activities for all", "Learning Activities for all", 0, "Module #: Learning Activities"),
    ("Assignment | Essay | Part 2", "Assignment: Essay Part 2", 1, "Module #: Assignment Essay Part 2"), ("Reading list", "Reading list", 1, "Reading list"), ("Discussion", "Discussion", 1, "Module #: Discussion [Title Here]"),
    ("Student resources", "Student resources", 1, "Student resources"), ("Activities", "Activities", None, None), ("Introduction to all", "Introduction to all", 0, "Module #: Introduction and Checklist"), ("Survey: 2 | Feedback", "Survey 2: Feedback", 1, "Quiz: 2: Feedback"),
]
MODULE_CASES = ["Module 0#: Name", "Faculty Resources for all", "Course Overview #", "Week #", "Module #: Name"]
_CHILD_COLUMNS = [list(c) for c in zip(*CHILD_CASES)]


@query(f"""
WITH c AS (SELECT p_partkey // 7 AS m, p_partkey AS o, 'i' || p_partkey AS item_id, {_case('p_partkey', _CHILD_COLUMNS[0])} AS raw, {_case('p_partkey', _CHILD_COLUMNS[1])} AS plain,
  {_case('p_partkey', ['NULL' if g is None else g for g in _CHILD_COLUMNS[2]], False)} AS g, replace({_case('p_partkey', [None if t is None else t.replace('#', '~') for t in _CHILD_COLUMNS[3]])}, '~', (p_partkey // 7)::VARCHAR) AS renamed FROM part),
t AS (SELECT *, m % 5 IN (0, 4) AS numbered, {_case('m', ['Module 0#: Name', 'Instructor Module (Do Not Publish)', 'Start Here', 'Week #', 'Module #: Name'])} AS module FROM c),
h AS (SELECT m, min(o) AS first, min(o) FILTER (raw = 'Student resources') AS help FROM t GROUP BY m),
r AS (SELECT m, module, item_id, CASE WHEN numbered THEN renamed ELSE plain END AS title, CASE WHEN numbered THEN g ELSE 0 END AS g, o * 2 AS o, 1 AS h FROM t WHERE NOT numbered OR g IS NOT NULL
  UNION ALL SELECT DISTINCT m, module, NULL, CASE g WHEN 0 THEN 'Overview' WHEN 1 THEN 'Activities' ELSE 'Review' END, g, -1, 0 FROM t WHERE numbered AND g IS NOT NULL
  UNION ALL SELECT m, 'Instructor Module (Do Not Publish)', NULL, 'About This Template', 0, -1, 0 FROM h WHERE m % 5 = 1
  UNION ALL SELECT m, 'Start Here', NULL, 'Canvas Support Resources', 0, help * 2 - 1, 0 FROM h WHERE m % 5 = 2 AND help > first)
SELECT 'm' || m AS parent_id, module, row_number() OVER (PARTITION BY m ORDER BY g, o)::INT AS position, h = 0 AS is_header, item_id, title FROM r""")
def module_structure(spark, sf):
    """Seven children a module, in modules of every kind."""
    k = F.col("p_partkey")
    m = F.floor(k / 7)
    p = table(spark, sf, "part")
    none = F.lit(None).cast("string")
    kids = p.select(F.lit("p").alias("package"), F.concat(F.lit("i"), k.cast("string")).alias("item_id"), F.concat(F.lit("m"), m.cast("string")).alias("parent_id"), F.lit(1).alias("depth"), k.alias("ordinal"), _pick(k, _CHILD_COLUMNS[0]).alias("title"))
    tops = p.select(m.alias("m")).distinct().select(F.lit("p").alias("package"), F.concat(F.lit("m"), F.col("m").cast("string")).alias("item_id"), none.alias("parent_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ordinal"), _pick(F.col("m"), MODULE_CASES).alias("title"))
    return manifest.restructure(kids.unionByName(tops.select(kids.columns))).drop("package")


_FRAGMENTS = "'<html><head><title>' || p_name || '</title></head><body><h1 id=\"t\">Part</h1><table style=\"width:' || (450 + p_size * 2) || 'px\"><tr><td>x</td></tr></table><div class=\"row\"><span> </span></div><p>' || p_brand || '</p></body></html>'"


def _fragments(spark, sf) -> DataFrame:
    """Pages with titles, first headings, tables of many widths and empty wrappers."""
    p = spread(table(spark, sf, "part"), "p_partkey")
    parts = [F.lit("<html><head><title>"), F.col("p_name"), F.lit('</title></head><body><h1 id="t">Part</h1><table style="width:'), (F.lit(450) + F.col("p_size") * 2).cast("string"), F.lit('px"><tr><td>x</td></tr></table><div class="row"><span> </span></div><p>'), F.col("p_brand"), F.lit("</p></body></html>")]
    return p.select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".html")).alias("path"), F.concat(*parts).alias("html"))


@query(r"""
SELECT p_partkey, md5('<html><head></head><body><h2 id="t">Part</h2><table style="width:' || CASE WHEN 450 + p_size * 2 > 500 THEN ' 100%; max-width: ' || (450 + p_size * 2) || 'px;' ELSE (450 + p_size * 2) || 'px' END || '"><tr><td>x</td></tr></table><p>' || p_brand || '</p></body></html>') AS digest,
 CASE WHEN 450 + p_size * 2 > 500 THEN 5 ELSE 4 END::BIGINT AS n_changes FROM part""")
def rewrite_chain_fragments(spark, sf):
    """The whole chain over fragments whose result can be written down."""
    from packloom.rewrite import chain

    out = chain.sanitise(_fragments(spark, sf))
    return out.select("p_partkey", F.md5("html").alias("digest"), F.size("changes").cast("long").alias("n_changes"))


#: Cards of accordions: page, and the page after the chain.
_CARD = '<div class="card"><div class="card-header">{}</div><div class="collapse show"><div class="card-body"><p>b</p></div></div></div>'
#: @ stands for the mark of a colour, as # is the key.
_DETAILS = '<details class="migration-accordion" style="margin: 16px 0; border: 1px solid @c8d1db; border-radius: 6px; background-color: @ffffff; overflow: hidden;">\n  <summary style="cursor: pointer; display: block; padding: 12px 16px; font-weight: 700; line-height: 1.4; text-align: left; background-color: @f4f6f8;">{}</summary>\n  <div class="migration-accordion__panel" style="padding: 12px 16px; text-align: left;"><p>b</p></div>\n</details>'
CARD_CASES = [
    ("w/lesson.html", _CARD.format("Part # &amp; more"), _DETAILS.format("Part # &amp; more")),
    ("w/syllabus.html", _CARD.format("<h3 class='card-title'>Part #</h3>"), "<h3>Part #</h3>\n<div><p>b</p></div>"),
    ("w/policy.html", _CARD.format("Section"), "<div><p>b</p></div>"),
    ("w/other.html", _CARD.format("<img src='x' alt='Picture #'>"), _DETAILS.format("Picture #")),
    ("w/other.html", _CARD.format(" "), _DETAILS.format("Section")),
    ("w/other.html", "<title>Course policy</title>" + _CARD.format("Part #"), _DETAILS.format("Part #")),
]


@query(f"SELECT s_suppkey, md5(replace({_case('s_suppkey', [c[2] for c in CARD_CASES])}, '@', chr(35))) AS digest FROM supplier".replace("\n", "' || chr(10) || '"))
def accordion_cards(spark, sf):
    """Cards of accordions in pages of every kind."""
    from packloom.rewrite import chain

    k = F.col("s_suppkey")
    pages = spread(table(spark, sf, "supplier"), "s_suppkey").select("s_suppkey", _pick(k, [c[0] for c in CARD_CASES]).alias("path"), _pick(k, [c[1] for c in CARD_CASES]).alias("html"))
    return chain.sanitise(pages).select("s_suppkey", F.md5("html").alias("digest"))


@query()
def rewrite_chain(spark, sf):
    """The whole chain over the pages: changes by pass."""
    from packloom.rewrite import chain

    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), "html")
    rows = chain.sanitise(pages).select("path", F.explode("changes").alias("c"))
    return rows.groupBy("c.description").agg(F.sum("c.count").alias("n"), F.count("*").alias("n_files"))


#: Pages with formulas, and what is counted in them: MathML, WIRIS annotations, equation
#: images, raw TeX, display blocks, empty stubs, absolute URLs, no alt, no source.
MATH_CASES = [
    ("<p><math><mi>x</mi></math></p>", [1, 0, 0, 0, 0, 0, 0, 0, 0]),
    ('<img class="a equation_image b" src="https://e.org/equation_images/a" alt=" ">', [0, 0, 1, 0, 0, 0, 1, 1, 1]),
    ("<p>\\(a\\) and $$b$$ \\[c\\] $5 \\$$</p>", [0, 0, 0, 3, 0, 0, 0, 0, 0]),
    ("<math><annotation encoding='wiris'>q</annotation></math><IMG data-equation-content=\"x\">", [1, 1, 0, 0, 0, 1, 0, 0, 0]),
    ("<p>none</p>", [0, 0, 0, 0, 0, 0, 0, 0, 0]),
    ('<p> <span class="s"><img title="t" alt="x" class="equation_image"></span></p><math display="block"><mn>1</mn></math>', [1, 0, 1, 0, 2, 0, 0, 0, 0]),
    ('<div class="migration-display-equation"><img data-equation-content="t" class="equation_image"></div><math mode=\'display\'> &nbsp; </math>', [1, 0, 1, 0, 1, 1, 0, 1, 0]),
    ("<math><mi>x</mi></math> \\(a\\) <img class='equation_image' src='/equation_images/a'>", [1, 0, 1, 1, 0, 0, 0, 1, 1]),
]
_MATH_NAMES = ["mathml", "wiris_annotation", "equation_image", "raw_tex_delimiter", "display_math_block", "empty_mathml_stub", "absolute_equation_image_url", "equation_images_missing_alt", "equation_images_missing_source"]
_MATH_SQL = f"""m(i, {', '.join(_MATH_NAMES)}) AS (SELECT * FROM (VALUES {', '.join(f"({i}, {', '.join(map(str, n))})" for i, (_, n) in enumerate(MATH_CASES))})),
f AS (SELECT s_suppkey AS path, b.*, a.mathml AS before, list_filter([CASE WHEN a.mathml > 0 THEN 'mathml' END, CASE WHEN a.equation_image > 0 THEN 'equation_image' END, CASE WHEN a.raw_tex_delimiter > 0 THEN 'raw_tex' END], lambda x: x IS NOT NULL) AS m1,
  list_filter([CASE WHEN b.mathml > 0 THEN 'mathml' END, CASE WHEN b.equation_image > 0 THEN 'equation_image' END, CASE WHEN b.raw_tex_delimiter > 0 THEN 'raw_tex' END], lambda x: x IS NOT NULL) AS m2
  FROM supplier JOIN m a ON a.i = s_suppkey // 3 % {len(MATH_CASES)} JOIN m b ON b.i = s_suppkey % {len(MATH_CASES)}),
g AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {c} > 0 THEN '{n}' END" for n, c in metrics.MATH_FLAGS)}, CASE WHEN len(m2) > 1 THEN 'mixed_math_modes' END], lambda x: x IS NOT NULL) AS flags FROM f)"""


def _math(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    pages = [c for c, _ in MATH_CASES]
    return metrics.math_audit(spread(table(spark, sf, "supplier"), "s_suppkey").select(k.alias("path"), _pick(F.floor(k / 3), pages).alias("original"), _pick(k, pages).alias("converted")))


@query(f"WITH {_MATH_SQL} SELECT path, before::BIGINT AS original_mathml_count, {', '.join(f'{c}::BIGINT AS converted_{c}_count' for c in _MATH_NAMES)}, array_to_string(m1, ',') AS original_math_modes, array_to_string(m2, ',') AS converted_math_modes, array_to_string(flags, ',') AS review_flags FROM g")
def math_audit(spark, sf):
    """Formulas of two versions of a page, all counts and flags."""
    lists = ("original_math_modes", "converted_math_modes", "review_flags")
    return _math(spark, sf).withColumns({c: F.array_join(c, ",") for c in lists})


@query(f"""WITH {_MATH_SQL} SELECT count(*)::BIGINT AS files_scanned, count(*) FILTER (mathml + equation_image + raw_tex_delimiter > 0)::BIGINT AS files_with_math, count(*) FILTER (len(flags) > 0)::BIGINT AS files_with_math_review_flags, count(*) FILTER (len(m2) > 1)::BIGINT AS files_with_mixed_math_modes, sum(before)::BIGINT AS total_original_mathml,
 sum(mathml)::BIGINT AS total_converted_mathml, sum(wiris_annotation)::BIGINT AS total_converted_wiris_annotations, sum(equation_image)::BIGINT AS total_converted_equation_images, sum(raw_tex_delimiter)::BIGINT AS total_converted_raw_tex_delimiters, sum(display_math_block)::BIGINT AS total_converted_display_math_blocks,
 sum(empty_mathml_stub)::BIGINT AS total_converted_empty_mathml_stubs, sum(absolute_equation_image_url)::BIGINT AS total_absolute_equation_image_urls, sum(equation_images_missing_alt)::BIGINT AS total_equation_images_missing_alt, sum(equation_images_missing_source)::BIGINT AS total_equation_images_missing_source FROM g""")
def math_summary(spark, sf):
    return metrics.math_summary(_math(spark, sf))


@query(f"""WITH {_VISUAL_SQL} SELECT count(*)::BIGINT AS files_scanned, count(*) FILTER (duplicate_title_first_block)::BIGINT AS files_with_duplicate_title_first_block, count(*) FILTER (converted_shared_template_refs > 0)::BIGINT AS files_with_remaining_shared_template_refs, count(*) FILTER (converted_title_tags > 0)::BIGINT AS files_with_remaining_title_tags,
 count(*) FILTER (converted_hr_nonstandard > 0)::BIGINT AS files_with_nonstandard_hr, count(*) FILTER (converted_template_icons_missing_size_style > 0)::BIGINT AS files_with_icon_size_anomalies, sum(original_accordion_cards)::BIGINT AS total_original_accordion_cards, sum(converted_details_blocks)::BIGINT AS total_converted_details_blocks,
 sum(original_mathml_count)::BIGINT AS total_original_mathml, sum(converted_mathml_count)::BIGINT AS total_converted_mathml, sum(converted_wiris_annotation_count)::BIGINT AS total_converted_wiris_annotations FROM v""")
def visual_summary(spark, sf):
    """Totals of what a conversion left or changed."""
    return metrics.visual_summary(_visual(spark, sf))


from packloom.operators import links, patterns, reports  # noqa: E402

_FILES = "SELECT 'f' || (p_partkey % 60) || '.pdf' AS name, p_partkey AS id FROM part WHERE p_partkey % 60 < 40 AND (p_partkey <= 60 OR p_partkey % 60 < 4)"
_LIVE = """SELECT s_suppkey, pos, attr, ref FROM (SELECT s_suppkey, 0 AS pos, 'href' AS attr, CASE s_suppkey % 4 WHEN 0 THEN '/d2l/x/' || s_suppkey WHEN 1 THEN '/shared/Brightspace_HTML_Template/a' WHEN 2 THEN 'http://e.org/a' ELSE 'd/F' || (s_suppkey % 60) || '.pdf?x=1' END AS ref FROM supplier UNION ALL SELECT s_suppkey, 1, 'src', 'sub/f' || (s_suppkey % 60) || '.pdf' FROM supplier)"""


def _live(spark, sf) -> DataFrame:
    s = F.col("s_suppkey")
    k, n = s % 4, (s % 60).cast("string")
    ref = F.when(k == 0, F.concat(F.lit("/d2l/x/"), s.cast("string"))).when(k == 1, "/shared/Brightspace_HTML_Template/a").when(k == 2, "http://e.org/a").otherwise(F.concat(F.lit("d/F"), n, F.lit(".pdf?x=1")))
    page = F.concat(F.lit('<p><a href="'), ref, F.lit('">x</a><img src=\'sub/f'), n, F.lit(".pdf'></p>"))
    refs = links.page_references(spread(table(spark, sf, "supplier"), "s_suppkey").select("s_suppkey", page.alias("html")), "s_suppkey")
    p = F.col("p_partkey")
    files = table(spark, sf, "part").where((p % 60 < 40) & ((p <= 60) | (p % 60 < 4))).select(F.concat(F.lit("f"), (p % 60).cast("string"), F.lit(".pdf")).alias("name"), p.alias("id"))
    aliases = spark.createDataFrame([("f45.pdf", 0, "f1.pdf"), ("f45.pdf", 1, "f20.pdf"), ("f46.pdf", 0, "no.pdf")], "source string, pos int, target string")
    return links.audit_references(refs, files, aliases)


_LIVE_SQL = f"""WITH f AS ({_FILES}), i AS (SELECT name, count(*) AS n, min(id) AS id FROM f GROUP BY name), r AS ({_LIVE}),
k AS (SELECT *, CASE WHEN ref LIKE '/d2l/%' THEN 'legacy_d2l_link' WHEN ref LIKE '/shared/%' THEN 'brightspace_template_link' WHEN ref LIKE 'http:%' THEN NULL ELSE 'relative_local_reference' END AS kind, lower(regexp_extract(regexp_replace(ref, '\\?.*', ''), '([^/]*)$', 1)) AS name FROM r),
j AS (SELECT k.*, i.n, i.id, CASE WHEN k.name = 'f45.pdf' THEN (SELECT id FROM i WHERE i.name = 'f20.pdf' AND i.n = 1) END AS alias_id FROM k LEFT JOIN i ON i.name = k.name WHERE kind IS NOT NULL),
a AS (SELECT s_suppkey, pos, attr, CASE WHEN kind <> 'relative_local_reference' THEN kind WHEN n = 1 THEN kind WHEN n > 1 THEN kind || '_collision' WHEN alias_id IS NOT NULL THEN kind || '_alias_match' ELSE kind || '_unresolved' END AS issue_type, CASE WHEN kind = 'relative_local_reference' THEN CASE WHEN n = 1 THEN id WHEN n IS NULL THEN alias_id END END AS asset FROM j)"""


@query(f"{_LIVE_SQL} SELECT s_suppkey, pos::INT AS pos, attr, issue_type, CASE WHEN issue_type IN ('relative_local_reference', 'relative_local_reference_alias_match') THEN 'info' ELSE 'warning' END AS severity, asset FROM a")
def link_audit(spark, sf):
    """References of pages by kind, with the file that would serve."""
    return _live(spark, sf).select("s_suppkey", "pos", "attr", "issue_type", "severity", "asset")


@query(f"{_LIVE_SQL} SELECT s_suppkey, count(*) FILTER (issue_type IN ('relative_local_reference', 'relative_local_reference_alias_match'))::BIGINT AS rewritten, count(*) FILTER (issue_type LIKE '%alias_match')::BIGINT AS via_alias, count(*) FILTER (issue_type LIKE '%collision' OR issue_type LIKE '%unresolved')::BIGINT AS unresolved FROM a GROUP BY 1")
def relink_totals(spark, sf):
    return links.relink_totals(_live(spark, sf), "s_suppkey")


@query(r"""
SELECT page_id % 12 AS package, count(*)::BIGINT AS page_count, sum(len(regexp_extract_all(html, '(?i)<li\b')))::BIGINT AS list_items, sum(len(regexp_extract_all(html, '(?i)<a\b')))::BIGINT AS links, sum(len(regexp_extract_all(html, '(?i)<h[1-6]\b')))::BIGINT AS headings FROM pages GROUP BY 1""")
def package_html_features(spark, sf):
    p = table(spark, sf, "pages").withColumn("package", F.col("page_id") % 12)
    return patterns.package_html_features(p).select("package", "page_count", "list_items", "links", "headings")


@query("""
SELECT * FROM (VALUES ('accordion_modernization', 12::BIGINT, 8::BIGINT, 0.667::DOUBLE, true), ('divider_normalization', 12::BIGINT, 4::BIGINT, 0.333::DOUBLE, false)) v(key, applicable, matching, rate, is_consensus)""")
def consensus_transforms(spark, sf):
    """Twelve packages of pages; accordions go in two of three, dividers in one."""
    p = table(spark, sf, "pages").withColumn("package", F.col("page_id") % 12)
    k = F.col("package") % 3
    before = p.withColumn("html", F.concat("html", F.lit('<div class="card-header">x</div><hr>')))
    after = p.withColumn("html", F.concat("html", F.when(k < 2, "").otherwise('<div class="card-header">x</div>'), F.when(k == 0, '<hr style="height: 2px">').otherwise("<hr>")))
    return patterns.consensus_transforms(patterns.package_html_features(before), patterns.package_html_features(after))


@query(r"""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Module ' || (o_orderkey % 30) || ': the module' WHEN 1 THEN 'By the end of this module, you will be able to: ' || o_orderpriority ELSE 'Introduction and Checklist' END AS text FROM orders""")
def module_wording(spark, sf):
    k = F.col("o_orderkey")
    t = F.when(k % 3 == 0, F.concat(F.lit("TOPIC 0"), (k % 30).cast("string"), F.lit(" - The topic"))).when(k % 3 == 1, F.concat(F.lit("After completing the learning activities for this topic, you will be able to : "), "o_orderpriority")).otherwise("Introduction and objectives")
    return table(spark, sf, "orders").select("o_orderkey", patterns.module_wording(t).alias("text"))


#: Path, title, role, number and chapter of pages.
ROLE_CASES = [
    ("01-cells_and-LIFE/Introduction and Objectives.html", "Cells", "module_intro", 1, "Cells And Life"), ("16-o'neil 2nd/x-objectives.html", "Text from", "module_intro", 16, "O'Neil 2Nd"), ("1-a/introduction.html", "x", "standalone", None, ""), ("introduction.html", "x", "standalone", None, ""),
    ("a/b.html", " Welcome from the Instructor", "welcome_instructor", None, ""), ("a/Welcome-Instructor.html", "x", "welcome_instructor", None, ""), ("a/b.html", "Welcome to the course", "standalone", None, ""), ("03-x/b.html", "Text from me", "welcome_instructor", None, ""),
]


@query(f"SELECT p_partkey, {_case('p_partkey', [c[2] for c in ROLE_CASES])} AS role, {_case('p_partkey', ['NULL' if c[3] is None else c[3] for c in ROLE_CASES], False)}::INT AS module_number, {_case('p_partkey', [c[4] for c in ROLE_CASES])} AS chapter_title FROM part")
def page_roles(spark, sf):
    """What each page is, by path and title."""
    k = F.col("p_partkey")
    pages = table(spark, sf, "part").select("p_partkey", _pick(k, [c[0] for c in ROLE_CASES]).alias("path"), _pick(k, [c[1] for c in ROLE_CASES]).alias("title"))
    return patterns.page_roles(pages, "path", F.col("title")).select("p_partkey", "role", "module_number", "chapter_title")


@query(r"""
SELECT count(*)::BIGINT AS files, count(*) FILTER (regexp_matches(html, '(?s)<!--.*?-->') OR regexp_matches(html, '&amp;') OR regexp_matches(html, '(?i)<br\s*/?>') OR regexp_matches(html, '<a href="[^"]*"'))::BIGINT AS changed_files FROM pages""")
def report_totals(spark, sf):
    """Totals of the replacement stage and the findings of its output."""
    df = rules.apply_replacements(table(spark, sf, "pages").withColumn("path", F.col("url")), REPLACEMENTS)
    h = F.col("html")
    files = df.select("path", (F.size("changes") > 0).alias("changed"), "changes", rules.triggered(h, TRIGGERS).alias("manual"), detect.accessibility(h).alias("accessibility"))
    return reports.file_summary(files).select("files", "changed_files")


from packloom.operators import corpus, review  # noqa: E402
from packloom.plans import convert  # noqa: E402


@query()
def converted_pages(spark, sf):
    """The conversion of all pages: findings and changes of each."""
    config = rules.Rules(REPLACEMENTS, REWRITES, TRIGGERS)
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), "html")
    out = convert.convert(pages, config, convert.Profile("strict"), best_practice=True)
    return out.select("path", "changed", F.size("changes").alias("n_changes"), F.size("manual").alias("n_manual"), F.size("accessibility").alias("n_accessibility"), F.md5("html").alias("digest"))


@query()
def review_pages(spark, sf):
    """Pages against their conversion: priority, score and similarity."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("path"), "html")
    after = pages.withColumn("html", F.regexp_replace("html", r"(?is)<(ul|title)\b[^>]*>.*?</\1>", ""))
    counts = _page_issues(spark, sf).groupBy(F.col("path")).agg(F.count(F.when(F.col("type") == "manual", 1)).alias("manual"), F.count(F.when(F.col("type") != "manual", 1)).alias("accessibility"))
    rows = review.review_rows(metrics.pair_versions(pages, after), counts)
    return rows.select("path", "priority", "score", "similarity")


@query("""
SELECT p.page_id AS path, CASE WHEN p.page_id % 3 = 0 THEN CASE WHEN p.page_id % 2 = 0 THEN 'updated' ELSE 'unchanged' END ELSE 'kept' END AS status, CASE WHEN p.page_id % 3 = 0 AND p.page_id % 2 = 0 THEN 'new ' || p.page_id ELSE 'page ' || p.page_id END AS html FROM pages p
UNION ALL SELECT -page_id - 1, 'missing', NULL FROM pages WHERE page_id % 10 = 0""")
def draft_write_back(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("path"))
    k = F.col("path")
    pages = p.select("path", F.concat(F.lit("page "), k.cast("string")).alias("html"))
    edit = F.concat(F.when(k % 2 == 0, "new ").otherwise("page "), k.cast("string"))
    drafts = p.where(k % 3 == 0).select("path", edit.alias("edited_body_html")).unionByName(p.where(k % 10 == 0).select((-k - 1).alias("path"), F.lit("x").alias("edited_body_html")))
    return review.apply_drafts(pages, drafts)


@query("""
WITH c AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'ABC-' || (1000 + s_suppkey) WHEN 1 THEN 'sec ' || (1000 + s_suppkey) WHEN 2 THEN 'zz ' || (1000 + s_suppkey) || ' q' ELSE 'none' || s_suppkey END AS course FROM supplier)
SELECT course, CASE WHEN s_suppkey % 4 < 3 THEN 's' || s_suppkey END AS snapshot, CASE s_suppkey % 4 WHEN 0 THEN 'token' WHEN 1 THEN 'contains' WHEN 2 THEN 'number' END AS how FROM c""")
def snapshot_match(spark, sf):
    """Courses to snapshots by an equal token, by containment and by number; the snapshots
    are listed by supplier, and the first in the list that holds a token is its own."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    n = (k + 1000).cast("string")
    course = F.when(k % 4 == 0, F.concat(F.lit("ABC-"), n)).when(k % 4 == 1, F.concat(F.lit("sec "), n)).when(k % 4 == 2, F.concat(F.lit("zz "), n, F.lit(" q"))).otherwise(F.concat(F.lit("none"), k.cast("string")))
    name = F.when(k % 4 == 0, F.concat(F.lit("abc "), n)).when(k % 4 == 1, F.concat(F.lit("Fall sec "), n, F.lit(" x"))).otherwise(F.concat(F.lit("other "), n))
    return corpus.match_snapshots(s.select(course.alias("course")), s.where(k % 4 < 3).select(k.alias("pos"), F.concat(F.lit("s"), k.cast("string")).alias("snapshot"), name.alias("name")))


@query("""
WITH f AS (SELECT o_custkey % 50 AS course, o_orderkey % 3 AS root, o_orderpriority AS kind, o_orderkey AS path, o_orderdate AS ts FROM orders),
s AS (SELECT course, root, count(DISTINCT kind) AS k FROM f GROUP BY ALL), b AS (SELECT course, root FROM (SELECT *, row_number() OVER (PARTITION BY course ORDER BY k DESC, root) AS r FROM s) WHERE r = 1)
SELECT course, kind, root, path FROM (SELECT f.*, row_number() OVER (PARTITION BY course, kind ORDER BY ts DESC, path) AS r FROM f JOIN b USING (course, root)) WHERE r = 1""")
def course_artifacts(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("course"), (F.col("o_orderkey") % 3).alias("root"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("ts"))
    return corpus.best_artifacts(o).select("course", "kind", "root", "path")


@query("""
SELECT arg_max(v, event_id) AS value, max(event_id) AS last FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || (user_id % 20) AS v FROM events) GROUP BY lower(v) ORDER BY last DESC LIMIT 25""")
def recent_history(spark, sf):
    """The 25 latest different values (the feature is a bounded history)."""
    e = table(spark, sf, "events").select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), (F.col("user_id") % 20).cast("string")).alias("v"))
    return corpus.recent_distinct(e, "event_id", "v")


@query("""
SELECT p_size % 10 AS package, count(*) FILTER (p_partkey % 3 = 0)::BIGINT AS topic_html_files, count(*) FILTER (p_partkey % 3 = 1)::BIGINT AS module_html_files, count(*)::BIGINT AS html_files FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1""")
def package_structure(spark, sf):
    k = F.col("p_partkey")
    folder = F.when(k % 3 == 0, "Topic 1").when(k % 3 == 1, "x/module2 a").otherwise("other")
    path = F.concat(folder, F.lit("/p"), k.cast("string"), F.when(k % 5 == 0, ".png").otherwise(".HTM"))
    return corpus.structure_summary(table(spark, sf, "part").select((F.col("p_size") % 10).alias("package"), path.alias("path")))


@query("""
WITH r AS (SELECT p_size % 4 AS package, p_partkey % 4 AS k FROM part)
SELECT kind, sum(n)::BIGINT AS n, count(DISTINCT package)::BIGINT AS packages FROM (SELECT package, CASE k WHEN 0 THEN 'exact' WHEN 1 THEN 'legacy' WHEN 2 THEN 'external' ELSE 'unresolved' END AS kind, count(*) AS n FROM r GROUP BY ALL) GROUP BY kind""")
def reference_classes(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_size") % 4).alias("package"), "p_partkey")
    k = F.col("p_partkey")
    page = F.concat(F.lit("d/p"), k.cast("string"), F.lit(".html"))
    ref = F.when(k % 4 == 0, F.concat(F.lit("p"), k.cast("string"), F.lit(".html#top"))).when(k % 4 == 1, "/d2l/a").when(k % 4 == 2, "https://e.org").otherwise("nowhere.html")
    pages = p.select("package", page.alias("path"), F.concat(F.lit('<a href="'), ref, F.lit('">x</a>')).alias("html"))
    return corpus.corpus_totals(corpus.reference_classes(pages, pages.select("package", "path")))


_SIDES = "a AS (SELECT doc_id, text FROM documents WHERE lang IN ('en', 'de')), b AS (SELECT doc_id, text FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3'))"
_FOLD = r"""regexp_replace(translate(lower(trim({}, ' ')), '“”’', '""' || chr(39)), '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g')"""


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents")
    return d.where("lang in ('en', 'de')"), d.where("source in ('src0', 'src1', 'src2', 'src3')")


@query(rf"""WITH {_SIDES},
la AS (SELECT {_FOLD.format('line')} AS key, arg_min(line, (doc_id, pos)) AS line FROM (SELECT doc_id, generate_subscripts(l, 1) AS pos, trim(unnest(l), ' ') AS line FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM a)) WHERE line <> '' GROUP BY 1),
lb AS (SELECT {_FOLD.format('line')} AS key, arg_min(line, (doc_id, pos)) AS line FROM (SELECT doc_id, generate_subscripts(l, 1) AS pos, trim(unnest(l), ' ') AS line FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM b)) WHERE line <> '' GROUP BY 1),
u AS (SELECT 'missing' AS side, key, line FROM la WHERE key NOT IN (SELECT key FROM lb) UNION ALL SELECT 'extra', key, line FROM lb WHERE key NOT IN (SELECT key FROM la))
SELECT side, rank::INT AS rank, line FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY key) AS rank FROM u WHERE length(line) >= 25) WHERE rank <= 40""")
def instruction_gap_lines(spark, sf):
    """The first forty lines that one of two sets of texts has and the other lacks."""
    return sets.instruction_gap(*_sides(spark, sf), "text", "doc_id")


PHRASES = [(w, w, f"why {w}") for w in ("license", "@mail1.example.com", "|", "$$$", "zzz not there", "token = ", "The  And")]


@query(rf"""WITH {_SIDES}, s(phrase, folded) AS (SELECT * FROM {_values([(p, ' '.join(p.lower().split())) for p, _, _ in PHRASES])})
SELECT phrase AS id, phrase, 'why ' || phrase AS rationale FROM s WHERE EXISTS (SELECT 1 FROM a WHERE contains({_FOLD.format('text')}, folded)) AND NOT EXISTS (SELECT 1 FROM b WHERE contains({_FOLD.format('text')}, folded))""")
def critical_phrases(spark, sf):
    """Phrases of one set of texts that another lacks."""
    a, b = _sides(spark, sf)
    return sets.critical_gaps(a, b, "text", PHRASES)


@query(f"{_LIVE_SQL}, c AS (SELECT issue_type, CASE s_suppkey % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'assignment' ELSE 'discussion' END AS content_type FROM a) SELECT 'issue_type' AS kind, issue_type AS value, count(*)::BIGINT AS n FROM c GROUP BY 2 UNION ALL SELECT 'content_type', content_type, count(*)::BIGINT FROM c GROUP BY 2")
def live_audit_counts(spark, sf):
    """Findings of the live audit by kind and by content."""
    k = F.col("s_suppkey") % 3
    return links.audit_counts(_live(spark, sf).withColumn("content_type", F.when(k == 0, "page").when(k == 1, "assignment").otherwise("discussion")))


#: Children of shell modules in packages, and those of the template.
SHELL_CHILDREN = ["Welcome!", "welcome", "Course Tour", "My own page #", "Extra", "Help & more", " - "]
SHELL_TEMPLATE = [("Start Here", "Welcome"), ("Start Here", "Course  Tour"), ("Instructor Module (Do Not Publish)", "Help and More"), ("Instructor Module (Do Not Publish)", "Unused")]
_SHELL_SQL = f"""k AS (SELECT p_partkey % 40 AS package, CASE p_partkey % 3 WHEN 0 THEN 'Start Here' WHEN 1 THEN 'Instructor Module (Do Not Publish)' ELSE 'Week 1' END AS shell, {_case('p_size', SHELL_CHILDREN)} AS title FROM part)"""


def _shells(spark, sf):
    k = F.col("p_partkey")
    shell = F.when(k % 3 == 0, "Start Here").when(k % 3 == 1, "Instructor Module (Do Not Publish)").otherwise("Week 1")
    kids = table(spark, sf, "part").select((k % 40).alias("package"), shell.alias("shell"), _pick(F.col("p_size"), SHELL_CHILDREN).alias("title"))
    return patterns.protected_shells(kids, spark.createDataFrame(SHELL_TEMPLATE, "shell string, title string"), 40)


@query(f"WITH {_SHELL_SQL} SELECT shell AS title, count(DISTINCT package)::BIGINT AS training_course_presence, 2::BIGINT AS template_child_count, count(DISTINCT package) >= 20 AS recommended_protected_shell FROM k WHERE shell <> 'Week 1' GROUP BY 1")
def protected_shells(spark, sf):
    """Shell modules that packages share with the template."""
    return _shells(spark, sf)[0]


@query(f"""WITH {_SHELL_SQL}, n AS (SELECT shell, CASE WHEN shell = 'Start Here' AND lower(title) IN ('welcome!', 'welcome') THEN 'Welcome' WHEN shell = 'Start Here' AND title = 'Course Tour' THEN 'Course  Tour' WHEN shell <> 'Start Here' AND title = 'Help & more' THEN 'Help and More' END AS own, title FROM k WHERE shell <> 'Week 1' AND title <> ' - '),
g AS (SELECT shell, CASE WHEN own IS NULL THEN 'custom' ELSE 'intact' END AS kind, coalesce(own, title) AS title, count(*)::BIGINT AS course_count FROM n GROUP BY ALL)
SELECT shell, kind, title, course_count FROM (SELECT *, row_number() OVER (PARTITION BY shell, kind ORDER BY course_count DESC, title) AS r FROM g) WHERE course_count >= 2 AND (kind = 'intact' OR r <= 12)""")
def shell_children(spark, sf):
    """Children of shell modules that recur."""
    return _shells(spark, sf)[1]


@query(f"""WITH c AS (SELECT DISTINCT p_name AS t FROM part WHERE p_size < 25), k AS (SELECT kind, name, packages FROM (SELECT 'title' AS kind, upper(p_name) || '!' AS name, count(*)::BIGINT AS packages, p_name FROM part GROUP BY p_name) JOIN c ON t = p_name
 UNION ALL SELECT 'asset', p_brand || '.png', count(*)::BIGINT FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size < 5) GROUP BY p_brand)
SELECT kind, name, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY packages DESC, name) AS rank FROM k) WHERE rank <= 10""")
def current_alignment(spark, sf):
    """Kept template elements that the current package has."""
    p = table(spark, sf, "part")
    title, asset = F.lit("title").alias("kind"), F.lit("asset").alias("kind")
    png = F.concat("p_brand", F.lit(".png"))
    current = p.where("p_size < 25").select(title, F.col("p_name").alias("name")).unionByName(p.where("p_size < 5").select(asset, F.lower(png).alias("name")))
    kept = p.groupBy("p_name").agg(F.count("*").alias("packages")).select(title, F.concat(F.upper("p_name"), F.lit("!")).alias("name"), "packages").unionByName(p.groupBy("p_brand").agg(F.count("*").alias("packages")).select(asset, png.alias("name"), "packages"))
    return patterns.current_alignment(current, kept)


@query("""WITH f AS (SELECT s_nationkey, s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'other-2024' ELSE 'elearn-standard-template-export' END || CASE s_suppkey % 5 WHEN 0 THEN '' ELSE '-20' || (240000 + s_suppkey % 900) END || CASE s_suppkey % 2 WHEN 0 THEN 'B' ELSE 'a' END || CASE s_suppkey % 7 WHEN 0 THEN '.zip' ELSE '.imscc' END AS name FROM supplier)
SELECT s_nationkey, 't/' || arg_max(name, (CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 20240000 + s_suppkey % 900 END, lower(name))) AS template FROM f WHERE name LIKE 'elearn%.imscc' GROUP BY 1""")
def latest_templates(spark, sf):
    """The latest template export of each folder, by the date in its name."""
    k = F.col("s_suppkey")
    parts = [F.when(k % 4 == 0, "t/other-2024").otherwise("t/elearn-standard-template-export"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("-20"), (k % 900 + 240000).cast("string"))), F.when(k % 2 == 0, "B").otherwise("a"), F.when(k % 7 == 0, ".zip").otherwise(".imscc")]
    return patterns.latest_template(table(spark, sf, "supplier").select("s_nationkey", F.concat(*parts).alias("path")), ["s_nationkey"])


@query("""SELECT p_size AS package, 'p' || p_partkey || '.html' AS path FROM part WHERE p_partkey % 3 <> 0""")
def files_outside_manifest(spark, sf):
    """Members that no manifest names."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    path = F.concat(F.lit("p"), k.cast("string"), F.lit(".html"))
    members = p.select(F.col("p_size").alias("package"), path.alias("path")).unionByName(p.select(F.col("p_size").alias("package"), F.lit("imsmanifest.xml").alias("path")).distinct())
    line = F.concat(F.when(k % 3 == 0, F.lit('<file HREF = "')).otherwise(F.lit("<file href='")), path, F.when(k % 3 == 0, F.lit('"/>')).otherwise(F.lit("'/>")))
    return patterns.files_outside_manifest(members, p.select(F.col("p_size").alias("package"), line.alias("xml")))


#: Explicit code, snapshot's path, source's path, snapshot's code, and what follows.
CODE_CASES = [
    (" BIO # ", "a/b.json", "c/d.zip", "x", "BIO #"), ("", "courses/CHEM #/s.json", "c/d.zip", "x", "CHEM #"), (None, "w/Output/s.json", "w/ART #/s.zip", "x", "ART #"),
    (None, "w/output/s.json", "resources/s.zip", " S# ", "S#"), ("", None, "s.zip", "", "current-course"), (None, None, None, None, "current-course"),
]


@query(f"SELECT s_suppkey, {_case('s_suppkey', [c[4] for c in CODE_CASES])} AS code FROM supplier")
def course_codes(spark, sf):
    """The code of a course, from whatever tells it first."""
    k = F.col("s_suppkey")
    at = lambda i: _pick(k, [c[i] for c in CODE_CASES])
    return table(spark, sf, "supplier").select("s_suppkey", patterns.course_code(at(0), [at(1), at(2)], at(3)).alias("code"))


import packloom.plans.measure_queries  # noqa: E402, F401  these add their queries to this table
import packloom.plans.source_queries  # noqa: E402, F401
import packloom.plans.template_queries  # noqa: E402, F401
import packloom.plans.training_queries  # noqa: E402, F401

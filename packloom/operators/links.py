"""Link audit and relinking: every reference of a page, classified and resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.arrow import unescape
from packloom.functions.html import attribute, basename, compare_key, decode_basic, is_local, matches, plain_text, url_path
from packloom.operators.resolve import best_targets, resolve_assets

#: Addresses of the old system and of its shared template.
LEGACY = r"(?i)^/?(?:d2l/|content/enforced/)"
TEMPLATE = r"(?i)^/?shared/brightspace_html_template/"
_NEUTRAL = r"(?is)<a\b[^>]*\bdata-migration-link-status\s*=\s*[\"']needs-review[\"'][^>]*>.*?</a>"


def page_references(pages: DataFrame, key: str, text: str = "html") -> DataFrame:
    """DataFrame[key, pos, attr, ref] of href and src values in order."""
    pairs = matches(F.col(text), r"""(?i)(?:^|\s)(?:href|src)\s*=\s*["'][^"']+["']""")
    rows = pages.select(key, F.posexplode(pairs).alias("pos", "x"))
    attr = F.lower(F.regexp_extract("x", r"(?i)\b(href|src)\b", 1))
    ref = F.trim(F.regexp_extract("x", r"""(?s)=\s*["']([^"']+)["']""", 1))
    return rows.select(key, "pos", attr.alias("attr"), ref.alias("ref")).where("ref <> ''")


def neutralised_links(pages: DataFrame, key: str, text: str = "html") -> DataFrame:
    """DataFrame[key, pos, original, link_text] of links marked for review."""
    rows = pages.select(key, F.posexplode(matches(F.col(text), _NEUTRAL)).alias("pos", "x"))
    original = F.coalesce(attribute(F.col("x"), "data-migration-original-href"), F.lit(""))
    return rows.select(key, "pos", unescape(F.trim(original)).alias("original"), plain_text(F.regexp_extract("x", r"(?is)^<a\b[^>]*>(.*)</a>$", 1)).alias("link_text"))


def assignment_targets(links: DataFrame, targets: DataFrame) -> DataFrame:
    """DataFrame[link_id, url]: the best target (key, url) of each link text."""
    return best_targets(links, targets).where("url is not null").select("link_id", "url")


def page_targets(links: DataFrame, targets: DataFrame) -> DataFrame:
    """DataFrame[link_id, url]: the best syllabus page (key, url) of the links whose
    text is "syllabus"; those for online courses first, none for f2f."""
    k = F.col("key")
    f2f = F.contains(k, F.lit("f2f"))
    longer = k.startswith("syllabus ") & ~f2f
    score = F.when(longer & F.contains(k, F.lit("online")), 100).when(longer, 95).when(k == "syllabus", 90).when(k.startswith("syllabus") & ~f2f, 85)
    best = targets.withColumn("score", score).where("score is not null").agg(F.max(F.struct("score", "url")).alias("b")).where("b is not null")
    return links.where("text = 'syllabus'").crossJoin(best).select("link_id", F.col("b.url").alias("url"))


def suggest_targets(links: DataFrame, pages: DataFrame, assignments: DataFrame, key: str) -> DataFrame:
    """``links`` (from :func:`neutralised_links`) with ``suggested``: quick links and
    surveys go to the best assignment, content links named "syllabus" to the best
    page. ``pages`` and ``assignments`` have (title, url)."""
    low = F.lower("original")
    to = F.when(low.rlike(r"[?&]type=survey(?:&|#|$)") | F.contains(url_path(low), F.lit("quicklink.d2l")), "assignment").when(F.contains(url_path(low), F.lit("/d2l/le/content/")), "page")
    rows = links.withColumn("link_id", F.struct(key, "pos")).withColumn("text", compare_key(F.col("link_text"))).withColumn("to", to)
    done = None
    for kind, targets, match in (("assignment", assignments, assignment_targets), ("page", pages, page_targets)):
        part = rows.where(F.col("to") == kind)
        t = targets.select(compare_key(F.col("title")).alias("key"), "url").where("key <> '' and url <> ''")
        got = match(part.select("link_id", "text"), t)
        done = got if done is None else done.unionByName(got)
    return rows.join(done, "link_id", "left").select(*links.columns, F.coalesce("url", F.lit("")).alias("suggested"))


def audit_references(refs: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """References with ``issue_type``, ``severity`` and the file ``asset`` that would
    serve: legacy, template, or local with its outcome. Others are left out.

    ``files`` has (name, id), ``aliases`` (source, pos, target).
    """
    r = F.col("ref")
    kind = F.when(r.rlike(LEGACY), "legacy_d2l_link").when(r.rlike(TEMPLATE), "brightspace_template_link").when(is_local(r), "relative_local_reference")
    rows = refs.withColumn("kind", kind).where("kind is not null").withColumn("name", F.lower(basename(url_path(F.url_decode(F.replace(r, F.lit("+"), F.lit("%2B")))))))
    found = resolve_assets(rows, files, aliases, stop_on_duplicate=True, stop_on_alias_duplicate=False)
    local = F.col("kind") == "relative_local_reference"
    end = F.when(F.col("outcome") == "collision", "_collision").when(F.col("outcome") == "unmapped", "_unresolved").when(F.col("outcome") == "alias", "_alias_match").otherwise("")
    issue = F.when(local, F.concat("kind", end)).otherwise(F.col("kind"))
    severity = F.when(local & F.col("outcome").isin("direct", "alias"), "info").otherwise("warning")
    return found.select(*refs.columns, issue.alias("issue_type"), severity.alias("severity"), F.when(local, F.col("asset")).alias("asset"))


def target_url(course: str | Column, attr: Column, file_id: Column) -> Column:
    c = F.lit(course) if isinstance(course, str) else course
    return F.concat(F.lit("/courses/"), c, F.lit("/files/"), file_id.cast("string"), F.when(attr == "src", "/preview").otherwise("/download?wrap=1"))


def relink_totals(audited: DataFrame, key: str) -> DataFrame:
    """Links rewritten, through an alias, and unresolved, of each page."""
    n = lambda *ends: F.count(F.when(F.col("issue_type").isin(*("relative_local_reference" + e for e in ends)), 1))
    return audited.groupBy(key).agg(n("", "_alias_match").alias("rewritten"), n("_alias_match").alias("via_alias"), n("_collision", "_unresolved").alias("unresolved"))


def audit_counts(findings: DataFrame) -> DataFrame:
    """DataFrame[kind, value, n]: findings (issue_type, content_type) by each."""
    g = findings.groupingSets([["issue_type"], ["content_type"]], "issue_type", "content_type").agg(F.count("*").alias("n"), F.grouping("issue_type").alias("g"))
    return g.select(F.when(F.col("g") == 0, "issue_type").otherwise("content_type").alias("kind"), F.when(F.col("g") == 0, F.col("issue_type")).otherwise(F.col("content_type")).alias("value"), "n")


def issue_pages(issues: DataFrame, url: str) -> DataFrame:
    """Distinct page slugs that import issues point to."""
    slug = F.regexp_extract(url_path(F.col(url)), r"/(?:pages|wiki)/([^/]+)", 1)
    return issues.select(slug.alias("slug")).where("slug <> ''").distinct()


__all__ = ["audit_counts", "audit_references", "decode_basic", "issue_pages", "neutralised_links", "page_references", "relink_totals", "suggest_targets", "target_url"]

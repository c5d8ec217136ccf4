"""Queries over the files of training courses."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from packloom.operators import standards, training
from packloom.plans.registry import _case, _pick, query
from packloom.rewrite import merge
from packloom.runtime import table

#: Paths below a course's folder, by part: kind and rank of each.
PATHS = [
    ("before/d2l-export.zip", "before_zip", 0), ("before/x#.zip", "before_zip", -1), ("y#.zip", "before_zip", -2), ("after/canvas-gold-export.imscc", "after_zip", 0), ("after/z#.imscc", "after_zip", -1), ("w#.imscc", "after_zip", -2),
    ("after/canvas-snapshot.json", "snapshot_json", 0), ("after/s#.snapshot.json", "snapshot_json", -1), ("after/s#.snapshot.md", "snapshot_markdown", -1), ("baseline/canvas-migration-issues.json", "issues_json", 0), ("canvas-migration-issues.json", "issues_json", -1), ("metadata.json", "metadata_json", 0), ("other/deep/x#.zip", None, 0),
]
_NAMES = [k for k, _ in training.KINDS]
_FILES = f"""f AS (SELECT p_partkey % 3 AS root, CASE WHEN p_partkey % 29 = 0 THEN '_old' WHEN p_partkey % 31 = 0 THEN 'Template' ELSE 'c' || (p_partkey % 23) END AS course, p_size AS mtime, {_case('p_partkey', [p for p, _, _ in PATHS])} AS path, {_case('p_partkey', [k for _, k, _ in PATHS])} AS kind, {_case('p_partkey', [r for _, _, r in PATHS], False)} AS rank FROM part),
b AS (SELECT root, course, kind, arg_max(path, (rank, mtime, path)) AS path FROM f WHERE kind IS NOT NULL AND course NOT IN ('_old', 'Template') GROUP BY ALL),
w AS (SELECT root, course, {', '.join(f"max(path) FILTER (kind = '{k}') AS {k}" for k in _NAMES)}, count(*) AS score FROM b GROUP BY ALL),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course ORDER BY score DESC, root) AS r FROM w WHERE coalesce(before_zip, after_zip, snapshot_json, issues_json) IS NOT NULL) WHERE r = 1)"""


def _artifacts(spark, sf):
    k = F.col("p_partkey")
    course = F.when(k % 29 == 0, "_old").when(k % 31 == 0, "Template").otherwise(F.concat(F.lit("c"), (k % 23).cast("string")))
    return training.discover(table(spark, sf, "part").select((k % 3).alias("root"), course.alias("course"), _pick(k, [p for p, _, _ in PATHS]).alias("path"), F.col("p_size").alias("mtime")))


@query(f"WITH {_FILES} SELECT course, root, {', '.join(_NAMES)}, score::INT AS completeness_score FROM a")
def training_files(spark, sf):
    """Files of training courses by kind."""
    return _artifacts(spark, sf)


@query(f"WITH {_FILES} SELECT course, root, before_zip, after_zip, length(before_zip)::INT AS before_pages, length(after_zip)::INT AS after_pages FROM a WHERE before_zip IS NOT NULL AND after_zip IS NOT NULL")
def training_pairs(spark, sf):
    """Courses with both packages and the features of each."""
    a = _artifacts(spark, sf)
    names = a.select(F.explode(F.array("before_zip", "after_zip")).alias("package")).where("package is not null").distinct()
    pairs = training.training_pairs(a, names.withColumn("pages", F.length("package")))
    return pairs.select("course", "root", "before_zip", "after_zip", F.col("before.pages").alias("before_pages"), F.col("after.pages").alias("after_pages"))


@query(f"WITH {_FILES} SELECT course FROM a WHERE snapshot_json IS NOT NULL AND course <> 'c7'")
def training_profiles(spark, sf):
    """Courses with a snapshot other than the current one."""
    rows = _artifacts(spark, sf).withColumn("has_snapshot", F.col("snapshot_json").isNotNull())
    return training.training_profiles(rows, "C-7").select("course")


#: Descriptions of import issues.
ISSUES = [training.QUIZ_KEY, training.MISSING_PAGE_LINK, "Other #"]


@query(f"""WITH i AS (SELECT o_custkey % 40 AS course, CASE o_orderkey % 2 WHEN 0 THEN 'pre' ELSE 'post' END AS phase, {_case('o_orderkey', ISSUES)} AS d FROM orders)
SELECT course, count(*) FILTER (phase = 'pre')::BIGINT AS pre_import_issue_total, count(*) FILTER (phase = 'pre' AND d LIKE 'Missing%')::BIGINT AS pre_import_missing_page_links, count(*) FILTER (phase = 'post')::BIGINT AS post_import_issue_total, count(*) FILTER (phase = 'post' AND d LIKE 'Missing%')::BIGINT AS post_import_missing_page_links, count(*) FILTER (phase = 'post' AND d LIKE 'The importer%')::BIGINT AS post_import_quiz_key_warnings FROM i GROUP BY 1""")
def import_issue_totals(spark, sf):
    """Import issues of each course, before and after."""
    k = F.col("o_orderkey")
    return training.issue_totals(table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("course"), F.when(k % 2 == 0, "pre").otherwise("post").alias("phase"), _pick(k, ISSUES).alias("description")))


@query(f"SELECT s_suppkey, {_case('s_suppkey', ['true', 'false', 'true', 'false'], False)} AS negative FROM supplier")
def negative_statements(spark, sf):
    """Advice on what not to do."""
    text = _pick(F.col("s_suppkey"), ["Do  NOT use #", "Use #", "please Avoid #", None])
    return table(spark, sf, "supplier").select("s_suppkey", training.negative_statement(text).alias("negative"))


@query("""WITH r AS (SELECT o_custkey % 20 AS package, o_custkey % 7 AS path, o_orderkey AS pos, 'r' || o_orderkey AS ref FROM orders)
SELECT package, rank::INT AS rank, path, ref FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY path, pos) AS rank FROM r) WHERE rank <= 40""")
def unresolved_samples(spark, sf):
    """The first unresolved references of each package."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    refs = table(spark, sf, "orders").select((c % 20).alias("package"), (c % 7).alias("path"), k.alias("pos"), F.concat(F.lit("r"), k.cast("string")).alias("ref"))
    return training.unresolved_sample(refs).select("package", F.col("rank").cast("int").alias("rank"), "path", "ref")


@query("""SELECT 'c1' AS course, CASE s_suppkey % 2 WHEN 0 THEN 's' || s_suppkey ELSE lower(replace(s_name, '#', '-')) END AS slug, ' ' || s_name || '!' AS title, 'b' AS body, CASE s_suppkey % 2 WHEN 0 THEN 'update' ELSE 'create' END AS action FROM supplier""")
def page_updates(spark, sf):
    """Pages to be written to a course."""
    k = F.col("s_suppkey")
    pages = table(spark, sf, "supplier").select(F.when(k % 2 == 0, F.concat(F.lit("s"), k.cast("string"))).alias("slug"), F.concat(F.lit(" "), "s_name", F.lit("!")).alias("title"), F.lit("b").alias("html"))
    return training.page_updates(pages, "c1")


@query("""SELECT s_nationkey AS package, arg_min('h' || s_suppkey, 'w/x-' || s_suppkey || '/Home-Page.HTML') AS html, min('w/x-' || s_suppkey || '/Home-Page.HTML') AS path FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1""")
def pages_by_key(spark, sf):
    """The page of each template that a key names."""
    k = F.col("s_suppkey")
    path = F.concat(F.lit("w/x-"), k.cast("string"), F.when(k % 3 == 0, "/Home-Page.png").otherwise("/Home-Page.HTML"))
    return training.pages_by_name(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("package"), path.alias("path"), F.concat(F.lit("h"), k.cast("string")).alias("html")), "home-page")


_SHELL = merge.INTRO_BODY.replace("#", "@").replace("\n", "~")
#: Pages of packages by kind: path, page, the page after the merge, and what was done.
MERGE_CASES = [
    ("0#1-cells_of-life/Introduction.html", "<title>x</title><body class='a'><p>Printer-friendly version</p><h2>The Introduction</h2><p>in #</p><p>&nbsp;</p><h2>Objectives</h2><ol><li>o #</li></ol></body>", "<title>Module #1: Cells Of Life: Introduction and Objectives</title><body>~" + _SHELL.replace("{intro}", "<p>in #</p>").replace("{objectives}", "<ul>~  <li>o #</li>~</ul>") + "~</body>", "template_wrapped"),
    ("a#.html", "<p>#</p>", "<p>#</p>", "passthrough"),
    ("welcome/instructor.html", "<body><div><h1>Me</h1><p>bio #</p></div></body>", merge.REDIRECT.replace("\n", "~"), "merged_into_about_instructor"),
    ("CourseOverview/Home Page.html", "<p>own #</p>", "<p>own #</p>", "passthrough"),
]
TEMPLATE_PAGES = [("about-the-instructor.html", '<meta name="identifier" content="old"/><body><h3>[Type Name Here] x</h3><p>y</p><hr>z</body>'), ("home-page.html", "<p>home</p>"), ("next-steps.html", '<img src="$IMS-CC-FILEBASE$/template-images/a/Icon.png">'), ("other.html", "x")]
_ABOUT_ID = hashlib.md5(merge.ABOUT_SEED.encode()).hexdigest()


@query(f"""WITH p AS (SELECT s_suppkey AS package, i, CASE i {' '.join(f"WHEN {i} THEN '{c[0]}'" for i, c in enumerate(MERGE_CASES))} END AS path, CASE i {' '.join("WHEN %d THEN '%s'" % (i, c[2].replace("'", "''")) for i, c in enumerate(MERGE_CASES))} END AS html, CASE i {' '.join(f"WHEN {i} THEN '{c[3]}'" for i, c in enumerate(MERGE_CASES))} END AS action FROM supplier, range(4) t(i)),
a AS (SELECT package, path, html, action FROM p UNION ALL SELECT DISTINCT package, 'CourseOverview/About the Instructor.html', '<meta name="identifier" content="g{_ABOUT_ID}"/><body><p>bio #</p>~<hr>z</body>', 'added_from_template' FROM p UNION ALL SELECT DISTINCT package, 'CourseOverview/Next Steps.html', '<img src="../TemplateAssets/Icon.png">', 'added_from_template' FROM p)
SELECT package, replace(path, '#', '') AS path, md5(replace(replace(replace(replace(html, 'Module #1', 'Module 1'), '#', package::VARCHAR), '@', chr(35)), '~', chr(10))) AS digest, action FROM a""")
def template_merge(spark, sf):
    """Packages merged with a template."""
    cases = F.array(*(F.struct(F.lit(c[0].replace("#", "")).alias("path"), F.lit(c[1]).alias("html")) for c in MERGE_CASES))
    pages = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("package"), F.explode(cases).alias("x")).select("package", "x.path", F.replace("x.html", F.lit("#"), F.col("package").cast("string")).alias("html"))
    got = merge.merge(pages, spark.createDataFrame(TEMPLATE_PAGES, "name string, html string"))
    return got.select("package", "path", F.md5("html").alias("digest"), "action")


#: Pages and modules of two templates, and what they prescribe.
STANDARD_PAGES = [
    [
        ("w/template-image-customizations.html", "<p style='border-bottom: 10px  solid #AC1A2F'>45px decorative AC1A2F, two separate elements</p><hr>"),
        ("w/z-template-image-customizations.html", "<p>later</p>"), ("w/module-introduction-and-checklist.html", "<h2>Start</h2><h3> </h3><h3>Check &amp; go</h3>"), ("w/module-learning-activities-template.html", "<p>Video title, transcript, timestamp and citation</p>"),
        ("w/module-lesson-title-template.html", "<p>Paste text <b>without</b> formatting; accordion</p>"), ("wiki_content/home-page.html", "<div style='background: #EEEEEE'>Syllabus Course Q&amp;A. This course is open to AI usage</div>"), ("wiki_content/home-page-stem.html", "<p>AI Excellence Institute</p>"),
        ("wiki_content/syllabus-2.html", "<p>Return to Table of Contents</p>"), ("wiki_content/about-the-instructor.html", "<p>a sense of belonging</p>"), ("wiki_content/policies-and-support.html", "x"), ("w/template-introduction-and-instructions.html", "<p>Course Credentials. It replaces the Course Overview Survey</p>"), ("w/a.png", "accordion"),
    ],
    [("w/a.html", "<p>plain</p>"), ("wiki_content/syllabus-f2f.html", "<p>f</p>"), ("w/c.html", "<p>course credentials</p>")],
]
STANDARD_MODULES = [[("Start Here", ["Welcome", "Tour"], 0), ("Module 1: Cells", ["a"], 1), ("Module 1: Late", ["b"], 2)], [("The Course Conclusion", ["Course Credentials", "End"], 0), ("Instructor Module (Do Not Publish)", ["About"], 1)]]
STANDARD_ROWS = [
    ("Start|Check & go", 45, "true", "ac1a2f", "border-bottom: 10px solid #ac1a2f", "unstyled <hr>", "#eeeeee", "Welcome|Tour", "", "a", "", "false", "true", "true", "true", "true", "true", "true", "false", "true", "Syllabus|Course Q&A", "Online", "true", "Health Sciences=Syllabus+Course Q&A|STEM=AI Excellence Institute", "1"),
    ("", -1, "false", "", "", "", "", "", "About", "", "Course Credentials|End", "true", "true", "false", "false", "false", "false", "false", "false", "false", "", "Face-to-Face", "false", "", "0"),
]
STANDARD_COLUMNS = ["ic_sections", "width", "decorative", "red", "primary_rule", "separator", "background", "start_here", "instructor", "lesson", "conclusion", "in_shell", "mentioned", "citation", "accordion", "survey", "paste", "ai_notice", "contents", "belonging", "links", "variants", "policies", "homes", "warned"]


@query("SELECT s_suppkey AS package, " + ", ".join(("CASE s_suppkey % 2 WHEN 0 THEN {} ELSE {} END AS {}" if c == "width" else "CASE s_suppkey % 2 WHEN 0 THEN '{}' ELSE '{}' END AS {}").format(a, b, c) for a, b, c in zip(*STANDARD_ROWS, STANDARD_COLUMNS)) + " FROM supplier")
def template_standards(spark, sf):
    """What templates prescribe."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(k.alias("package"))
    case = lambda make, rows: F.when(F.col("package") % 2 == 0, F.array(*map(make, rows[0]))).otherwise(F.array(*map(make, rows[1])))
    pages = s.select("package", F.explode(case(lambda r: F.struct(F.lit(r[0]).alias("path"), F.lit(r[1]).alias("html")), STANDARD_PAGES)).alias("x")).select("package", "x.*")
    modules = s.select("package", F.explode(case(lambda r: F.struct(F.lit(r[0]).alias("module"), F.array(*map(F.lit, r[1])).alias("titles"), F.lit(r[2]).alias("ordinal")), STANDARD_MODULES)).alias("x")).select("package", "x.*")
    t = standards.template_standards(pages, modules)
    join = lambda c: F.array_join(c, "|")
    text = lambda c: F.col(c).cast("string")
    homes = F.array_join(F.transform("home_page_variants", lambda v: F.concat(v.division, F.lit("="), F.array_join(v.links, "+"))), "|")
    values = [join("ic_sections"), F.coalesce("heading_icon_width_px", F.lit(-1)), text("decorative_icon_alt_expected"), F.col("red_hex"), F.col("primary_page_heading_rule"), F.col("internal_separator_rule"), F.col("home_page_header_background"), join("start_here_items"), join("instructor_module_items"), join("lesson_module_items"), join("course_conclusion_items"), text("course_credentials_in_shell"), text("instructions_reference_course_credentials"), text("view_requires_video_title_transcript_timestamp_citation"), text("accordion_guidance_present"), text("start_here_replaces_course_overview_survey"), text("paste_without_formatting_guidance_present"), text("home_page_ai_notice_present"), text("syllabus_has_table_of_contents"), text("about_instructor_belonging_language_present"), join("home_page_links"), join("syllabus_variants_present"), text("policies_support_page_present"), homes, F.size("warnings").cast("string")]
    return t.select("package", *(v.alias(c) for v, c in zip(values, STANDARD_COLUMNS)))

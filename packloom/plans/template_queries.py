"""Queries over templates: labels, icons, assets, targets, introduction pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from packloom.functions import html as H
from packloom.operators import metrics, overlay, patterns, render, resolve, sets
from packloom.plans import registry
from packloom.plans.registry import _CHECKLIST_SQL, _MATH_SQL, _case, _pick, query
from packloom.runtime import spread, table

#: Label, icon, and the label in the template's wording.
LABEL_CASES = [
    ("Watch", "", "View"), ("Anything", "a/Video.png", "View"), ("Syllabus", "bookmark.png", "Syllabus"), ("Bookmark", "Bookmark.png", "Title"), ("Other #", "bookmark.png", "Other #"),
    ("Learning Objectives:", "star.png", "Module Objectives"), ("Course Material & Outcomes", "", "Course Materials and Outcomes"), ("x #", "checklist.png", "Checklist"), ("Module checklist", "", "Module Checklist"), ("x #", "w\\Checkmark.PNG", "Module Checklist"),
    (" introduction ", "", "Introduction"), ("Explore   Resources or files", "", "Additional Resources"), ("Flashcards and/or games", "", "Practice"), ("Important Note", "", "Important"), ("Info", "", "Information"), ("due date", "", "Due Dates"),
    ("About the Instructor", "", "Instructor Information"), ("Support", "", "Technical Support"), ("Main Point", "flag.png", "Main Point"), ("Student Support", "", "Student Support"), ("x #", "flag.png", "Guidelines"), ("Course Communication", "", "Communication"),
    ("Hints", "", "Help Links"), ("x", "megaphone.png", "Announcement"), ("Reminders", "", "Reminder"), ("Read this", "", "Read"), ("Hear This", "", "Listen"), ("download", "", "Download"), ("Do this", "", "Do This"), ("Assignment", "", "Instructions"),
    ("AI usage", "", "AI Usage Allowed"), ("Quiz # also represents tests", "", "Quiz #"), ("- Plain #: ", "other.png", "Plain #"), ("&nbsp;", "other.png", ""),
]
#: Icon, label, title, and the icon that they call for.
ICON_CASES = [
    ("a.png", "", "", "a.png"), ("a.png", "Review it", "", "circle-arrow.png"), ("a.png", "x", "Sample Forms", "folder.png"), ("a.png", "Knowledge  Check", "", "rocket.png"), ("a.png", "", "Chapter #", "book.png"), ("a.png", "Help desk", "", "gear.png"),
    ("a.png", "Office Hours", "", "educator.png"), ("a.png", "Course Q and A", "", "mail.png"), ("a.png", "Guidelines", "", "flag.png"), ("a.png", "Due date", "", "calendar.png"), ("a.png", "Announcement", "", "megaphone.png"), ("a.png", "Assignment Directions", "", "pencil.png"),
    ("a.png", "Artificial Intelligence", "", "ai-brain.png"), ("a.png", "View", "a lecture", "video.png"), ("view.png", "x", "y", "bookmark.png"), ("a.png", "Watch", "", "video.png"), ("a.png", "View", "", "bookmark.png"), ("rocket.png", "x", "", "folder.png"), ("reminder.png", "x", "", "circle-arrow.png"), ("a.png", "Plain #", "b", "a.png"),
]


@query(f"SELECT p_partkey, {_case('p_partkey', [c[2] for c in LABEL_CASES])} AS label FROM part")
def heading_labels(spark, sf):
    """Labels of headings in the template's wording."""
    k = F.col("p_partkey")
    return spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", overlay.heading_label(_pick(k, [c[0] for c in LABEL_CASES]), _pick(k, [c[1] for c in LABEL_CASES])).alias("label"))


@query(f"SELECT p_partkey, {_case('p_partkey', [c[3] for c in ICON_CASES])} AS icon FROM part")
def semantic_icons(spark, sf):
    """Icons that labels and titles call for."""
    k = F.col("p_partkey")
    at = lambda i: _pick(k, [c[i] for c in ICON_CASES])
    return spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", overlay.semantic_icon(at(0), at(1), at(2)).alias("icon"))


@query("""WITH a AS (SELECT lower(p_brand) || '-' || (p_size % 9) || '.png' AS name, min('w/' || lpad(p_partkey::VARCHAR, 9, '0')) AS source, count(*) AS n FROM part GROUP BY 1)
SELECT name, source, 'TemplateAssets/' || name AS target, CASE WHEN n > 1 THEN 'collision' WHEN name LIKE '%-3.png' THEN 'existing' ELSE 'copied' END AS outcome FROM a""")
def new_assets(spark, sf):
    """Assets of a template that a package has not yet."""
    p = table(spark, sf, "part")
    name = F.concat(F.col("p_brand"), F.lit("-"), (F.col("p_size") % 9).cast("string"), F.lit(".png"))
    assets = p.select(name.alias("name"), F.concat(F.lit("w/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("path"))
    return overlay.new_assets(assets, p.select(F.concat(F.lit("TemplateAssets/"), F.lower("p_brand"), F.lit("-3.png")).alias("path")))


@query("""WITH p AS (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN ' u/' || p_partkey END AS own, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey END AS id, CASE WHEN p_size % 8 = 0 THEN ' ' ELSE ' ' || p_name || ' & "x" ' END AS t FROM part)
SELECT p_name || ' & "x"' AS title, p_name || ' and x' AS key, coalesce(nullif(trim(own), ''), '/courses/c9/pages/' || id) AS url FROM p WHERE trim(t) <> '' AND (trim(own) <> '' OR id IS NOT NULL)""")
def content_targets(spark, sf):
    """Titles, keys and addresses of a course's pages."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    items = p.select(F.when(k % 4 != 0, k).alias("id"), F.when(F.col("p_size") % 8 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(' & "x" '))).alias("title"), F.when(k % 3 == 0, " ").when(k % 3 == 1, F.concat(F.lit(" u/"), k.cast("string"))).alias("html_url"))
    return overlay.content_targets(items, "c9", "pages")


_RULE = "chr(10) || '<hr style=\"border: 0; height: 2px; background-color: #ac1a2f; width: 100%; margin: 16px 0;\">' || chr(10)"


@query(f"""WITH s AS (SELECT s_suppkey, s_nationkey, '<p>this module: ' || s_name || '</p>' AS d, 'i' || s_suppkey || '.html' AS path, CASE s_suppkey % 3 WHEN 0 THEN '<body>x</BODY> y' WHEN 1 THEN 'x ' ELSE 'a <b>this  module</b> ' || s_name || ' z' END AS html FROM supplier WHERE s_suppkey % 5 NOT IN (3, 4))
SELECT s_nationkey AS package, 'm' || s_suppkey AS item_id, path, CASE s_suppkey % 3 WHEN 0 THEN '<body>x' || {_RULE} || d || chr(10) || '</body> y' WHEN 1 THEN 'x' || chr(10) || {_RULE} || d || chr(10) ELSE html END AS html, s_suppkey % 3 <> 2 AS moved FROM s""")
def moved_descriptions(spark, sf):
    """Descriptions of modules in their introduction pages."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    n = k.cast("string")
    none = F.lit(None).cast("string")
    package = F.col("s_nationkey").alias("package")
    tops = s.select(package, F.concat(F.lit("m"), n).alias("item_id"), none.alias("parent_id"), F.lit(0).alias("depth"), k.alias("ordinal"), F.when(k % 5 == 3, "Week 1").otherwise(F.concat(F.lit("Topic 0"), n, F.lit(" | x"))).alias("title"), none.alias("identifierref"), F.when(k % 5 == 4, "plain").otherwise(F.concat(F.lit(" <p>This topic: "), "s_name", F.lit("</p> "))).alias("description"))
    kid = lambda i, title: s.select(package, F.concat(F.lit(f"k{i}-"), n).alias("item_id"), F.concat(F.lit("m"), n).alias("parent_id"), F.lit(1).alias("depth"), (k + i).alias("ordinal"), F.lit(title).alias("title"), F.concat(F.lit(f"r{i}-"), n).alias("identifierref"), none.alias("description"))
    items = tops.unionByName(kid(1, "Overview")).unionByName(kid(2, "Introduction & Objectives")).unionByName(kid(3, "Intro and Objectives"))
    path = F.concat(F.lit("i"), n, F.lit(".html"))
    html = F.when(k % 3 == 0, "<body>x</BODY> y").when(k % 3 == 1, "x ").otherwise(F.concat(F.lit("a <b>this  module</b> "), "s_name", F.lit(" z")))
    return overlay.move_descriptions(items, s.select(package, F.concat(F.lit("r2-"), n).alias("identifier"), path.alias("href")), s.select(package, path.alias("path"), html.alias("html")), patterns.module_wording)


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'p.' || page_id ELSE trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')) END AS title FROM pages""")
def page_titles(spark, sf):
    """Titles of pages, or the stems of their names."""
    k = F.col("page_id")
    pages = table(spark, sf, "pages").withColumn("path", F.concat(F.lit("d.x/p."), k.cast("string"), F.lit(".html")))
    title = F.when(k % 3 == 0, "").otherwise(H.title_text(F.col("html")))
    return overlay.titles_or_names(pages, title).select("page_id", "title")


#: Path, title, heading, and whether the page is a syllabus.
SYLLABUS_CASES = [("w\\Syllabus.html", "", "", True), ("a", "Course SYLLABUS", "x", True), ("a", "", "Class Meeting  schedule", False), ("a", "", "Class meeting schedule #", True), ("syllabus/a", "Syllabus Quiz", "", False), ("a", "b", "c", False), (None, None, None, False)]


@query(f"SELECT s_suppkey, {_case('s_suppkey', ['true' if c[3] else 'false' for c in SYLLABUS_CASES])} AS answer FROM supplier")
def syllabus_pages(spark, sf):
    """Which pages are syllabuses."""
    k = F.col("s_suppkey")
    at = lambda i: _pick(k, [c[i] for c in SYLLABUS_CASES])
    return spread(table(spark, sf, "supplier"), "s_suppkey").select("s_suppkey", overlay.is_syllabus(at(0), at(1), at(2)).cast("string").alias("answer"))


#: Lines of a policy document, by document.
POLICY_LINES = ["Start #", "We are NO longer  using the bar here #", "See Module 1: x", "Use the accessible accordion code. #", "recreate content in a simplified manner"]


@query(f"""WITH l AS (SELECT s_suppkey AS d, trim({_case('s_suppkey', POLICY_LINES)}) AS line FROM supplier)
SELECT bool_or(line LIKE 'We are%') AS pipes_deprecated, bool_or(line LIKE 'Use the%') AS accessible_accordion_allowed, bool_or(line LIKE 'See%') AS module_prefix_expected,
 coalesce(arg_min(line, d) FILTER (line LIKE 'We are%'), '') AS title_policy_excerpt, coalesce(arg_min(line, d) FILTER (line LIKE 'Use the%' OR line LIKE 'recreate%'), '') AS accordion_policy_excerpt FROM l""")
def policy_facts(spark, sf):
    """What best practices say of titles and accordions."""
    s = table(spark, sf, "supplier")
    text = F.concat(F.lit("\n  "), _pick(F.col("s_suppkey"), POLICY_LINES), F.lit(" \n"))
    return sets.policy_facts(s.select("s_suppkey", text.alias("text")), "text", "s_suppkey")


@query("""SELECT true AS closer_present, 'fill in text here,' || chr(92) || '[title here' || chr(92) || ']' AS placeholders""")
def template_placeholders(spark, sf):
    """Text that a template leaves to be filled in."""
    s = spread(table(spark, sf, "supplier"), "s_suppkey")
    text = F.when(F.col("s_suppkey") % 2 == 0, "x Fill in\n TEXT here").otherwise("[Title  Here] Contact your instructor with any questions or post in the course Q&A.")
    return sets.template_placeholders(s.select(text.alias("text")), "text").select("closer_present", F.array_join("placeholders", ",").alias("placeholders"))


_ICON = '<img src="TemplateAssets/{}" role="presentation" alt="" style="width: 45px; height: auto; vertical-align: middle; margin-right: 8px;">'
#: Pages, and what they are in the template; @ stands for the mark of a colour.
OVERLAY_CASES = [
    ("a.html", '<a href="/shared/Brightspace_HTML_Template/docs/Guide.pdf?x=1@p">#</a>', '<a href="TemplateAssets/guide.pdf?x=1@p">#</a>', 1, 0, 0, 0),
    ("a.html", "<a href='/shared/brightspace_html_template/old.pdf'>#</a>", "<a href='TemplateAssets/guide.pdf'>#</a>", 0, 1, 0, 0),
    ("a.html", '<a href="/shared/brightspace_html_template/none-#.pdf">x</a>', '<a href="/shared/brightspace_html_template/none-#.pdf">x</a>', 0, 0, 1, 0),
    ("a.html", '<a href="/shared/brightspace_html_template/Custom.css">#</a><a href="/shared/brightspace_html_template/twice.pdf">x</a>', '<a href="/shared/brightspace_html_template/Custom.css">#</a><a href="/shared/brightspace_html_template/twice.pdf">x</a>', 0, 0, 1, 1),
    ("a.html", '<p>#<img src="x/standardImages/tick.png" width="20"></p>', '<p>#<img src="TemplateAssets/checklist.png" style="width: 45px; height: auto; vertical-align: middle; margin-right: 8px;" alt="" role="presentation"></p>', 0, 1, 0, 0),
    ("a.html", '<p><img src="../TemplateAssets/checklist.png" alt="x"></p>#', f'<h3 style="color: @ac1a2f;">{_ICON.format("checklist.png")} <strong>Checklist</strong></h3>#', 0, 0, 0, 0),
    ("w/Learning Activities.html", '<h4 class="c"> <img src="TemplateAssets/video.png" alt=""> </h4>#', f'<h2 class="c" style="color: @ac1a2f;">{_ICON.format("video.png")} <strong>View</strong></h2>#', 0, 0, 0, 0),
    ("a.html", '<p>#<img src="p.jpg" alt="a" width="900" style="border: 1px"></p>', '<p>#<img src="p.jpg" alt="a" style="border: 1px; max-width: 100%; height: auto; display: block; margin: 20px auto; clear: both;"></p>', 0, 0, 0, 0),
    ("a.html", '<p>#<img src="p.jpg" style="float: Right; width: 90px"></p>', '<p>#<img src="p.jpg" style="width: 240px; max-width: 100%; height: auto; display: block; clear: both; margin: 20px 0 20px auto;"></p>', 0, 0, 0, 0),
    ("a.html", '<p>#<img src="p.jpg" width="90"></p>', '<p>#<img src="p.jpg" width="90"></p>', 0, 0, 0, 0),
]


@query(f"""SELECT s_suppkey, replace({_case('s_suppkey', [c[2] for c in OVERLAY_CASES])}, '@', chr(35)) AS html, {', '.join(f"{_case('s_suppkey', [c[3 + i] for c in OVERLAY_CASES], False)}::BIGINT AS {n}" for i, n in enumerate(("mapped_direct", "mapped_alias", "unresolved", "ignored")))},
 CASE s_suppkey % 10 WHEN 2 THEN '/shared/brightspace_html_template/none-' || s_suppkey || '.pdf' WHEN 3 THEN '/shared/brightspace_html_template/twice.pdf' END AS unmapped FROM supplier""")
def template_overlay(spark, sf):
    """Pages moved to a template."""
    from packloom.rewrite import overlay as page

    k = F.col("s_suppkey")
    names = [("guide.pdf",), ("Checklist.png",), ("twice.pdf",), ("TWICE.pdf",), ("video.png",)]
    aliases = [("old.pdf", 0, "missing.pdf"), ("old.pdf", 1, "guide.pdf"), ("tick.png", 0, "checklist.png")]
    t = page.load_template(spark.createDataFrame(names, "name string"), spark.createDataFrame(aliases, "source string, pos int, target string"))
    html = F.replace(_pick(k, [c[1] for c in OVERLAY_CASES]), F.lit("@"), F.lit("#"))
    pages = spread(table(spark, sf, "supplier"), "s_suppkey").select("s_suppkey", _pick(k, [c[0] for c in OVERLAY_CASES]).alias("path"), html.alias("html"))
    return page.overlay(pages, t).select("s_suppkey", "html", "mapped_direct", "mapped_alias", "unresolved", "ignored", "unmapped")


_HEAD = ' style="color: @ac1a2f;"'
_RED = "color: @ac1a2f; border-bottom: 10px solid @AC1A2F; padding: 10px;"
_SRC = '<img src="w/TemplateAssets/{}" alt="" role="presentation" style="width: 45px; vertical-align: middle; margin-right: 8px; height: auto;">'
#: Pages with icon blocks, headings and rules, and what they are in the template: path,
#: page, result, merged blocks, promoted headings, page headings, rules that went.
BLOCK_CASES = [
    # An icon and the text behind it; the words call for another icon, whose label is known.
    ("a.html", f'<p><span>{_SRC.format("x.png")}</span>&nbsp;</p>\n <div>Sample <b>Forms</b> #<img src="k.png"></div>z', f'<h3{_HEAD}>{_ICON.format("folder.png")} <strong>Additional Resources</strong></h3>\n<h4>Sample Forms #</h4>\n<p><img src="k.png"></p>z', 1, 0, 0, 0),
    # The same words as the label: no second heading.
    ("w/Learning Activities.html", f'{_SRC.format("q.png")}<p>&nbsp;{_SRC.format("x.png")}</p><p>About # it</p>', f'{_SRC.format("q.png")}<h2{_HEAD}>{_ICON.format("x.png")} <strong>About # it</strong></h2>', 1, 0, 0, 0),
    # Lists, links and long texts are no labels.
    ("a.html", f'<p>&nbsp;{_SRC.format("x.png")}</p><div>a <a href="b">#</a></div><p>&nbsp;{_SRC.format("x.png")}</p><p>1 2 3 4 5 6 7 8 9 10 11 12 #</p>', f'<p>&nbsp;{_SRC.format("x.png")}</p><div>a <a href="b">#</a></div><p>&nbsp;{_SRC.format("x.png")}</p><p>1 2 3 4 5 6 7 8 9 10 11 12 #</p>', 0, 0, 0, 0),
    # Three blocks: the first takes the second's place in its pass, so the third finds none.
    ("a.html", f'<p>{_SRC.format("x.png")}</p><p>&nbsp;{_SRC.format("y.png")}</p><h3>Reading #</h3>', f'<p>{_SRC.format("x.png")}</p><h3{_HEAD}>{_ICON.format("book.png")} <strong>Read</strong></h3>\n<h4>Reading #</h4>', 1, 0, 0, 0),
    # Empty blocks between icon and heading; boxes that end there go.
    ("a.html", f'<div><p>{_SRC.format("q.png")}</p></div> <p><em>&nbsp;</em></p><h2 class="c">Quiz #</h2>', f'<div><h2 class="c"{_HEAD}>{_ICON.format("rocket.png")} <strong>Quiz #</strong></h2>', 1, 0, 0, 0),
    ("a.html", f'<p>{_SRC.format("q.png")}</p><p></p><h5> </h5><p>\n</p><div><br><h4>Office hours</h4> </div>#', f'<h3{_HEAD}>{_ICON.format("educator.png")} <strong>Instructor Information</strong></h3>\n<h5>Office hours</h5>#', 1, 1, 0, 0),
    # Headings of level 4 with an icon.
    ("a.html", f'<h4 style="color: blue">{_SRC.format("x.png")} #</h4><h4>#</h4><h5>{_SRC.format("x.png")} #</h5>', f'<h3 style="color: blue">{_SRC.format("x.png")} #</h3><h4>#</h4><h5>{_SRC.format("x.png")} #</h5>', 0, 1, 0, 0),
    # Introductions: each heading once, the rule at the top goes.
    ("w/Introduction and Objectives.html", '<body><div><p>&nbsp;</p><hr></div><div><h3 style="padding: 1px; margin: 0">Introduction</h3></div><h1>Learning Objectives:<img src="#.png"></h1><h2>Checklist</h2><h2>CHECKLIST</h2></body>', f'<body><div><p>&nbsp;</p><div><h2 style="margin: 0; {_RED}">{_ICON.format("star.png")} <strong>Introduction</strong></h2></div><h2{_HEAD}>{_ICON.format("bullseye.png")} <strong>Module Objectives</strong></h2>\n<p><img src="#.png"></p><h2{_HEAD}>{_ICON.format("checkmark.png")} <strong>Module Checklist</strong></h2><h2>CHECKLIST</h2></body>', 0, 0, 3, 1),
    ("w/Introduction and Objectives.html", "<body>x<hr><h2>Introduction</h2>#</body>", f'<body>x<hr><h2 style="{_RED}">{_ICON.format("star.png")} <strong>Introduction</strong></h2>#</body>', 0, 0, 1, 0),
    # Learning activities: the first heading only.
    ("w\\Learning Activities - Week 2.html", "<body>\n<hr/><h1>Do &amp; see #</h1><h2>b</h2></body>", f'<body>\n<h2 style="{_RED}"><strong>{_ICON.format("bookmark.png")} Do &amp; see #</strong></h2><h2>b</h2></body>', 0, 0, 1, 1),
    ("Learning Activities.html", f'<h2> </h2><h2>#</h2>', f'<h2> </h2><h2>#</h2>', 0, 0, 0, 0),
]


@query(f"""SELECT p_partkey, replace({_case('p_partkey', [c[2] for c in BLOCK_CASES])}, '@', chr(35)) AS html, {', '.join(f"{_case('p_partkey', [c[3 + i] for c in BLOCK_CASES], False)}::BIGINT AS {n}" for i, n in enumerate(("merged", "promoted", "headings", "dividers")))} FROM part""")
def template_blocks(spark, sf):
    """Icon blocks, headings and rules of pages moved to a template."""
    from packloom.rewrite import overlay as page

    k = F.col("p_partkey")
    labels = {"folder.png": "Additional Resources", "book.png": "Read", "educator.png": "Instructor Information"}
    t = page.load_template(spark.createDataFrame([("x.png",), ("y.png",), ("q.png",)], "name string"), spark.createDataFrame([], "source string, pos int, target string"), labels)
    pages = spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", _pick(k, [c[0] for c in BLOCK_CASES]).alias("path"), F.replace(_pick(k, [c[1] for c in BLOCK_CASES]), F.lit("@"), F.lit("#")).alias("html"))
    n = lambda what: F.coalesce(F.get(F.filter("changes", lambda c: c["description"] == what), F.lit(0))["count"], F.lit(0)).alias
    return page.overlay(pages, t).select("p_partkey", "html", n(page.MERGED)("merged"), n(page.PROMOTED)("promoted"), n(page.HEADINGS)("headings"), n(page.DIVIDERS)("dividers"))


@query("""WITH h AS (SELECT p_partkey, lower('I' || p_size || '.PNG') AS name, p_name AS label FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0),
o AS (SELECT name, arg_min(label, lpad(p_partkey::VARCHAR, 9, '0')) AS label FROM h GROUP BY name),
k AS (SELECT * FROM o UNION ALL VALUES ('checklist.png', 'Checklist'), ('exclamation.png', 'Important'), ('info.png', 'Information')),
a AS (SELECT DISTINCT 'old' || p_size || '.png' AS source, p_size AS s FROM part),
t AS (SELECT source, 0 AS pos, 'none.png' AS target FROM a UNION ALL SELECT source, 1, 'i' || s || '.png' FROM a UNION ALL SELECT source, 2, 'info.png' FROM a)
SELECT * FROM k UNION ALL SELECT source, arg_min(label, pos) FROM t JOIN k ON k.name = t.target GROUP BY source""")
def icon_glossary(spark, sf):
    """Labels of icons that a template's pages explain."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    p = spread(table(spark, sf, "part"), "p_partkey")
    icon = F.concat(F.lit('<h3 class="x"><img alt="a" src="../images/Icons/I'), size, F.lit('.PNG"> <span>'), "p_name", F.lit("</span>&nbsp;or something else</h3><h2>no icon</h2>"))
    later = F.concat(F.lit('<h4><img src="x/icons/i'), size, F.lit('.png"> later</h4>'))
    html = F.concat(F.lit("<h1>a</h1>"), F.when(k % 5 == 0, F.lit("<h2><img src='/icons/none.gif'></h2>")).otherwise(F.concat(icon, later)))
    path = F.concat(F.lit("w/"), F.lpad(k.cast("string"), 9, "0"), F.when(k % 3 == 0, "-other.html").otherwise("-Template-Image-Customizations.html"))
    size = p.select("p_size").distinct()
    n = F.col("p_size").cast("string")
    aliases = size.select(F.concat(F.lit("Old"), n, F.lit(".png")).alias("source"), F.posexplode(F.array(F.lit("none.png"), F.concat(F.lit("I"), n, F.lit(".png")), F.lit("info.png"))).alias("pos", "target"))
    return overlay.glossary(p.select(path.alias("path"), html.alias("html")), aliases)


_OUTLINE = '<caption><h3>Course Outline (16-Week)</h3></caption><tr><th scope="col" style="background-color: @000000; color: @ffffff;">16-Week #</th></tr>'
#: Tables of syllabuses, and what they are in the template.
TABLE_CASES = [
    ("syllabus.html", '<table summary="x" style="height: 5px; color: red"><tr style="height: 4px"><th scope="column">16-Week #</th></tr></table>', f'<table style="color: red; border-collapse: collapse; width: 100%;" class="ic-Table ic-Table--hover-row ic-Table--striped" border="1">{_OUTLINE}</table>'),
    ("other.html", "<table><tr><td>Office hours #</td></tr></table>", "<table><tr><td>Office hours #</td></tr></table>"),
    ("syllabus.html", "<table><tr><td>Office hours #</td></tr></table>", '<table style="border-collapse: collapse;"><caption>Office Hours</caption><tr><td>Office hours #</td></tr></table>'),
    ("syllabus.html", '<div><table summary="Grading Policy"><caption>My # &amp; own</caption><tr><td>x</td></tr></table></div>', '<div><table style="border-collapse: collapse;"><caption>My # &amp; own</caption><tr><td>x</td></tr></table></div>'),
    ("syllabus.html", "<table><tr><th>Course Title:</th><td>C #</td></tr><tr><th>Credit Hours:</th><td><p>3</p></td></tr><tr><th>More</th><td></td></tr></table>", "<h3>Course Materials and Outcomes</h3>\n<ul>\n<li><strong>Course Title</strong>: C #</li>\n<li><strong>Credit Hours</strong><div><p>3</p></div></li>\n<li><strong>More</strong></li>\n</ul>"),
    ("syllabus quiz.html", "<table><tr><td>Office hours #</td></tr></table>", "<table><tr><td>Office hours #</td></tr></table>"),
    ("syllabus.html", "<table><tr><td>a<table><tr><td>Grading scale #</td></tr></table></td></tr></table>", '<table style="border-collapse: collapse;"><tr><td>a<table style="border-collapse: collapse;"><caption>Grading Scale</caption><tr><td>Grading scale #</td></tr></table></td></tr></table>'),
]


@query(f"SELECT s_suppkey, md5(replace({_case('s_suppkey', [c[2] for c in TABLE_CASES])}, '@', chr(35))) AS digest FROM supplier".replace("\n", "' || chr(10) || '"))
def syllabus_tables(spark, sf):
    """Tables of syllabuses in the template's form."""
    from packloom.rewrite import chain

    k = F.col("s_suppkey")
    pages = spread(table(spark, sf, "supplier"), "s_suppkey").select("s_suppkey", _pick(k, [c[0] for c in TABLE_CASES]).alias("path"), _pick(k, [c[1] for c in TABLE_CASES]).alias("html"))
    return chain.sanitise(pages).select("s_suppkey", F.md5("html").alias("digest"))


#: Description, title, and the description without the title.
DESCRIPTION_CASES = [
    ("<h2>The Cells #</h2><p>b</p>", "Cells #", "<p>b</p>"), ("<p>Printer-friendly version</p><p>Cells &amp; more #!</p>b", "cells and  more #", "<p>Printer-friendly version</p>b"), ("<p>a</p><p>b</p><p>c</p><p>Cells</p>", "Cells", "<p>a</p><p>b</p><p>c</p><p>Cells</p>"),
    ("<p>a</p><p> </p><h3>Introduction to cells of life</h3>z", "Introduction to cell of life", "<p>a</p><p> </p>z"), ("<p>Cells</p>", "", "<p>Cells</p>"), (None, "Cells", None), ("<div>Cells</div>", "Cells", "<div>Cells</div>"),
]


@query(f"SELECT s_suppkey, {_case('s_suppkey', [c[2] for c in DESCRIPTION_CASES])} AS description FROM supplier")
def item_descriptions(spark, sf):
    """Descriptions of items without the title that they repeat."""
    from packloom.rewrite import chain

    k = F.col("s_suppkey")
    return spread(table(spark, sf, "supplier"), "s_suppkey").select("s_suppkey", chain.without_leading_title(_pick(k, [c[0] for c in DESCRIPTION_CASES]), _pick(k, [c[1] for c in DESCRIPTION_CASES])).alias("description"))


_NEUTRAL = '<a href="@" data-migration-link-status="needs-review"{} data-migration-original-href="{}">'
_SPACER = "<p>&nbsp;</p>"
_EQUATION = 'style="max-width: 100%; height: auto; vertical-align: middle;"'
#: Pages, what the chain makes of them, and the sum of the counts of its changes.
CHAIN_CASES = [
    ("<title>Alpha #</title><p>b</p>", "<p>b</p>", 1),
    ("<p>a<math><mrow></mrow><annotation-xml>q</annotation-xml></math>#</p>", "<p>a#</p>", 1),
    ("<p>x #<img class='equation_image' src='/e/a'></p>", f"<p>x #<img class='equation_image' src='/e/a' {_EQUATION}></p>", 1),
    ("<p style='text-align: center'> <math display='block'><mi>#</mi></math> </p>", '<div class="migration-display-equation" style="margin: 16px 0; overflow-x: auto; overflow-y: hidden;"><div class="migration-display-equation__inner" style="text-align: center;"><math display=\'block\'><mi>#</mi></math></div></div>', 1),
    ('<p class="text-center keep p-5">#</p>', '<p class="keep" style="text-align: center; padding: 3rem;">#</p>', 3),
    ('<p class="row col-md-6 x courseTable">#</p>', '<p class="x">#</p>', 3),
    ('<link rel="stylesheet" href="/shared/Brightspace_HTML_Template/a.css">#', "#", 1),
    ('<script src="https://s.brightspace.com/a.js"></script>#', "#", 1),
    ('<p><img src="/shared/brightspace_html_template/a.png" alt="Cells #"></p>', '<p><span class="migration-template-image-text">Cells #</span></p>', 2),
    ('<p>#<img src="/shared/brightspace_html_template/a.png" alt="Banner"></p>', "<p>#</p>", 1),
    ('<p>#<img src="TemplateAssets/footer.png"></p>', "<p>#</p>", 1),
    ('<a href="/shared/brightspace_html_template/x">#</a>', _NEUTRAL.format(' data-migration-link-reason="brightspace-template-link"', "/shared/brightspace_html_template/x") + "#</a>", 1),
    ('<p style="position: absolute; top: 1px; color: red">#</p>', '<p style="color: red;">#</p>', 1),
    ('<div style="position: fixed; z-index: 3; top: 0">#</div>', "<div>#</div>", 1),
    ('<div style="gap: 1px; display: Grid; color: red; place-items: center">#</div>', '<div style="display: block; color: red;">#</div>', 1),
    ('<p style="columns: 2; column-rule-width: 1px; color: red">#</p>', '<p style="color: red;">#</p>', 1),
    ('<p style="column-gap: 2px">#</p>', '<p style="column-gap: 2px">#</p>', 0),
    ('<p class="migration-x" style="display: flex">#</p>', '<p class="migration-x" style="display: flex">#</p>', 0),
    ('<aside style="float: left">#<div style="float: right">x</div></aside>y', '<div class="migration-clearfix" style="overflow: hidden;"><aside style="float: left">#<div style="float: right">x</div></aside></div>y', 1),
    ('<section class="migration-y"><div style="float: right">#</div></section>', '<section class="migration-y"><div style="float: right">#</div></section>', 0),
    ('<div style="float: none">#</div>', '<div style="float: none">#</div>', 0),
    ("<h1 class='a'>#</h1>", "<h2 class='a'>#</h2>", 1),
    ('<p>#<a href="javascript:window.print()">Print</a></p>', "<p>#</p>", 1),
    ('<a href="javascript:go(1)">#</a>', _NEUTRAL.format(' data-migration-link-reason="javascript-href"', "javascript:go(1)") + "#</a>", 1),
    (f"{_SPACER}<p> <br></p>{_SPACER}{_SPACER}<p>#</p>", f"{_SPACER}~<p>#</p>", 3),
    (f"{_SPACER}{_SPACER}<p>#</p>", f"{_SPACER}{_SPACER}<p>#</p>", 0),
    ("<h2>&nbsp; &nbsp;<img src='a' style='max-width: 9px'><br><br><br>T #</h2>", "<h2><img src='a' style='max-width: 9px'> T #</h2>", 1),
    ('<p data-start="1" class="a" data-ccp-props=\'{}\'>#</p>', '<p class="a">#</p>', 2),
    ('<p style="--d2l-x: 1; color: red">#</p>', '<p style="color: red;">#</p>', 1),
    ('<p>#<img src="a" align="left" hspace="5"></p>', '<p>#<img src="a" style="float: left; margin: 0 12px 8px 0; margin-left: 5px; margin-right: 5px; max-width: 100%; height: auto;"></p>', 4),
    ('<p>#<img src="a"></p>', '<p>#<img src="a" style="max-width: 100%; height: auto;"></p>', 1),
    ('<table style="width: 640px; color: red"><tr><td>#</td></tr></table>', '<table style="color: red; width: 100%; max-width: 640px;"><tr><td>#</td></tr></table>', 1),
    ("<div><span> </span></div><footer></footer>#", "#", 3),
    ("<hr>#", '<hr style="border: 0; height: 2px; background-color: @ac1a2f; width: 100%; margin: 16px 0;">#', 1),
    ('<hr style="color: blue; width: 5px" />#', '<hr style="border: 0; height: 2px; background-color: blue; width: 100%; margin: 16px 0;" />#', 1),
    ("<title>The Cells</title><p> </p><h3>Cells</h3><p>#</p>", "<p> </p><p>#</p>", 2),
    ('<a href="/d2l/common/dialogs/quickLink/quickLink.d2l?ou=1&amp;type=coursefile&amp;fileId=docs%2Fa.pdf">#</a>', '<a href="docs/a.pdf">#</a>', 1),
    ('<a href="/content/enforced/a">#</a>', _NEUTRAL.format("", "/content/enforced/a") + "#</a>", 1),
    ('<a href="http://e.org/d2l/a">#</a>', '<a href="http://e.org/d2l/a">#</a>', 0),
]


@query(f"SELECT s_suppkey * {len(CHAIN_CASES)} + i AS id, replace(replace({_case('k', [c[1] for c in CHAIN_CASES])}, '@', chr(35)), '~', chr(10)) AS html, {_case('k', [c[2] for c in CHAIN_CASES], False)}::BIGINT AS n FROM (SELECT s_suppkey, i, s_suppkey * {len(CHAIN_CASES)} + i AS k FROM supplier, range({len(CHAIN_CASES)}) r(i))")
def chain_passes(spark, sf):
    """Every pass of the chain on a page of its own."""
    from packloom.rewrite import chain

    k = F.col("id")
    ids = spread(table(spark, sf, "supplier"), "s_suppkey").select(F.explode(F.sequence(F.col("s_suppkey") * len(CHAIN_CASES), F.col("s_suppkey") * len(CHAIN_CASES) + len(CHAIN_CASES) - 1)).alias("id"))
    pages = chain.sanitise(ids.select("id", F.lit("a.html").alias("path"), _pick(k, [c[0] for c in CHAIN_CASES]).alias("html")))
    return pages.select("id", "html", F.aggregate("changes", F.lit(0).cast("long"), lambda a, c: a + c["count"]).alias("n"))


_REMINDER = '<p class="migration-checklist-closer"><strong>Module Checklist Reminder:</strong> Contact your instructor with any course questions{}.</p>'
_FEED = " or use the Activity Feed on the Home Page"
#: Path, page, the page with best practices, and what changed, by first words.
PRACTICE_PAGES = [
    ("a.html", "<h2>a</h2><h4>b</h4><h4>c #</h4><h6>d</h6>", "<h2>a</h2><h3>b</h3><h4>c #</h4><h5>d</h5>", "Promoted 2"),
    ("a.html", '<a href="http://e.org/#">x</a><a href="b.html">y</a>', '<a href="http://e.org/#" target="_blank" rel="noopener noreferrer">x</a><a href="b.html">y</a>', "Updated 1"),
    ("a.html", '<a href="https://e.org/#" target="_self">x</a><a href="https://e" target="_BLANK" rel="NoOpener x">y</a>', '<a href="https://e.org/#" target="_self">x</a><a href="https://e" target="_BLANK" rel="NoOpener x noreferrer">y</a>', "Updated 1"),
    ("a.html", "<h3>Module Checklist</h3><p>#</p><ul><li>a</li></ul>", "<h3>Module Checklist</h3><p>#</p><ul><li>a</li>~  <li>Contact your instructor with any questions or post in the Course Q&amp;A.</li></ul>", "Added 1"),
    ("w/Introduction and Objectives.html", "<body><p>#</p></body>", f"<body><p>#</p>{_REMINDER.format('')}~</body>", "Added 1"),
    ("w/introduction and checklist.html", "<p>Activity Feed on the Home Page #</p>", f"<p>Activity Feed on the Home Page #</p>~{_REMINDER.format(_FEED)}", "Added 1"),
    ("w/introduction and checklist.html", f"<p>#</p>{_REMINDER.format('')}", f"<p>#</p>~{_REMINDER.format('')}", "Added 1"),
    ("w/introduction and checklist.html", "<p>Contact your instructor with any course questions. Activity Feed on the Home Page</p><ul><li>#</li> <li>Contact your instructor with any questions or post in the Course Q&amp;A.</li></ul>", "<p>Contact your instructor with any course questions. Activity Feed on the Home Page</p><ul><li>#</li>~</ul>", "Removed 1"),
    ("w/introduction and checklist.html", "<p>contact your instructor with any course questions. #</p>", "<p>contact your instructor with any course questions. #</p>", ""),
]


@query(f"SELECT s_suppkey, replace({_case('s_suppkey', [c[2] for c in PRACTICE_PAGES])}, '~', chr(10)) AS html, {_case('s_suppkey', [c[3] for c in PRACTICE_PAGES])} AS told FROM supplier")
def best_practice_pages(spark, sf):
    """Best practices applied to pages."""
    from packloom.rewrite import chain

    k = F.col("s_suppkey")
    none = F.array().cast("array<struct<category:string,description:string,count:bigint>>")
    pages = spread(table(spark, sf, "supplier"), "s_suppkey").select("s_suppkey", _pick(k, [c[0] for c in PRACTICE_PAGES]).alias("path"), _pick(k, [c[1] for c in PRACTICE_PAGES]).alias("html"), none.alias("changes"))
    told = F.array_join(F.transform("changes", lambda c: F.concat_ws(" ", F.split_part(c.description, F.lit(" "), F.lit(1)), c["count"])), ",")
    return chain.enforce(pages).select("s_suppkey", "html", told.alias("told"))




def _lines(report):
    return report.select("section", "key", "pos", "line")


_RANK = "CASE priority WHEN 'P0' THEN '0' WHEN 'P1' THEN '1' WHEN 'P2' THEN '2' WHEN 'P3' THEN '3' ELSE '9' END"
_FALL = "lpad((1000000000000 - n)::VARCHAR, 13, '0')"


@query(f"""WITH {_CHECKLIST_SQL}, x AS (SELECT *, {_RANK} || '|' || source || '|' || category || '|' || description AS o FROM a), n AS (SELECT count(*) AS n FROM a),
c AS (SELECT category, count(*) AS n, min(o) AS o FROM x GROUP BY 1), s AS (SELECT source, count(*) AS n, min(o) AS o FROM x GROUP BY 1), p AS (SELECT priority, count(*) AS n FROM x GROUP BY 1),
h(section, lines) AS (SELECT 0, ['# Migration Fix Checklist', '', '- Canvas issues input: `i.json`', '- Manual review input: none', '- Total checklist items: ' || n, '', '## Summary', ''] FROM n UNION ALL SELECT 2, [''] UNION ALL SELECT 4, ['', '## Category Counts', ''] UNION ALL SELECT 6, ['', '## Action Items', '']),
z(section, key, lines) AS (SELECT section, '', lines FROM h UNION ALL SELECT 1, {_RANK}, ['- ' || priority || ': ' || n] FROM p UNION ALL SELECT 3, o, ['- ' || source || ': ' || n] FROM s UNION ALL SELECT 5, {_FALL} || '|' || o, ['- ' || category || ': ' || n] FROM c
 UNION ALL SELECT 7, o, CASE WHEN reference = '' THEN [e, '  - Action: ' || action] ELSE [e, '  - Action: ' || action, '  - Reference: ' || reference] END FROM (SELECT *, '- [ ] (' || priority || ') [' || source || '] ' || category || ' | ' || description || ' | owner: ' || owner || ' | count: ' || count AS e FROM x))
SELECT section, key, (unnest(range(len(lines))))::INT AS pos, unnest(lines) AS line FROM z""")
def checklist_report(spark, sf):
    """The checklist as Markdown."""
    return _lines(render.checklist_report(registry._checklist(spark, sf), {"Canvas issues input": "i.json", "Manual review input": None}))


@query(f"""WITH {_MATH_SQL}, l(i, t, n) AS (SELECT 1, 'Files scanned', count(*) FROM g UNION ALL SELECT 2, 'Files with math', count(*) FILTER (mathml + equation_image + raw_tex_delimiter > 0) FROM g UNION ALL SELECT 3, 'Files with math review flags', count(*) FILTER (len(flags) > 0) FROM g UNION ALL SELECT 4, 'Files with mixed math modes', count(*) FILTER (len(m2) > 1) FROM g
 UNION ALL SELECT 5, 'MathML expressions in original', sum(before) FROM g UNION ALL SELECT 6, 'MathML expressions in converted', sum(mathml) FROM g UNION ALL SELECT 7, 'WIRIS annotations in converted', sum(wiris_annotation) FROM g UNION ALL SELECT 8, 'Canvas equation images in converted', sum(equation_image) FROM g UNION ALL SELECT 9, 'Raw TeX delimiters in converted', sum(raw_tex_delimiter) FROM g
 UNION ALL SELECT 10, 'Display math blocks in converted', sum(display_math_block) FROM g UNION ALL SELECT 11, 'Empty MathML stubs in converted', sum(empty_mathml_stub) FROM g UNION ALL SELECT 12, 'Absolute equation-image URLs', sum(absolute_equation_image_url) FROM g UNION ALL SELECT 13, 'Equation images missing alt', sum(equation_images_missing_alt) FROM g UNION ALL SELECT 14, 'Equation images missing source metadata', sum(equation_images_missing_source) FROM g)
SELECT 0 AS section, '' AS key, 3 + i AS pos, '- ' || t || ': ' || n AS line FROM l UNION ALL SELECT * FROM (VALUES (0, '', 0, '# Math Audit'), (0, '', 1, ''), (0, '', 2, '## Summary'), (0, '', 3, ''), (0, '', 18, ''), (0, '', 19, '## Files With Math Review Flags'), (0, '', 20, ''), (2, '', 0, ''))
 UNION ALL SELECT 1, path::VARCHAR, 0, '- `' || path || '`: ' || array_to_string(flags, ', ') FROM g WHERE len(flags) > 0""")
def math_report(spark, sf):
    """The audit of formulas as Markdown."""
    rows = registry._math(spark, sf)
    return _lines(render.math_report(rows, metrics.math_summary(rows)))


@query(f"""WITH u AS (SELECT lower('brand#' || (l_partkey % 60)) AS name, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT DISTINCT 'brand#' || p_size AS name FROM part), j AS (SELECT u.*, a.name IS NOT NULL AS ok FROM u LEFT JOIN a USING (name)),
s AS (SELECT sum(n) AS t, count(*) AS k, sum(n) FILTER (ok) AS m, count(*) FILTER (ok) AS mk, sum(n) FILTER (NOT ok) AS u, count(*) FILTER (NOT ok) AS uk FROM j),
h(section, lines) AS (SELECT 0, ['## Brightspace Reference Compatibility', '', '- Total Brightspace template reference hits in examples: ' || t, '- Unique Brightspace basenames: ' || k, '- Matched by basename in template package: ' || m || ' hits across ' || mk || ' names', '- Unmatched by basename: ' || u || ' hits across ' || uk || ' names', '', '## Top Unmatched Brightspace Basenames', ''] FROM s UNION ALL SELECT 2, ['', '## Top Matched Brightspace Basenames', ''])
SELECT section, '' AS key, (unnest(range(len(lines))))::INT AS pos, unnest(lines) AS line FROM h UNION ALL SELECT CASE WHEN ok THEN 3 ELSE 1 END, {_FALL} || '|' || name, 0, '- ' || name || ' (' || n || ')' FROM (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY n DESC, name) AS r FROM j) WHERE r <= 20""")
def compatibility_report(spark, sf):
    """Names of two templates as Markdown."""
    refs = table(spark, sf, "lineitem").select(F.concat(F.lit("Brand#"), (F.col("l_partkey") % 60).cast("string")).alias("name"))
    assets = table(spark, sf, "part").select(F.concat(F.lit("brand#"), F.col("p_size").cast("string")).alias("name"))
    return _lines(render.compatibility_report(resolve.availability(refs, assets)))


@query("""SELECT count(*)::BIGINT AS draft_pages, count(*) FILTER (s_suppkey % 3 = 0)::BIGINT AS pages_updated, count(*) FILTER (s_suppkey % 4 = 0)::BIGINT AS pages_missing, sum(s_suppkey % 5)::BIGINT AS manual_review_issues, sum(s_suppkey % 6)::BIGINT AS accessibility_issues, sum(s_nationkey)::BIGINT AS sanitizer_changes, sum(s_suppkey % 7)::BIGINT AS best_practice_changes FROM supplier""")
def write_back_totals(spark, sf):
    """Totals of a draft written back."""
    k = F.col("s_suppkey")
    return render.write_back_totals(table(spark, sf, "supplier").select((k % 3 == 0).alias("changed"), (k % 4 != 0).alias("found"), (k % 5).alias("manual_review_issues"), (k % 6).alias("accessibility_issues"), F.col("s_nationkey").alias("sanitizer_changes"), (k % 7).alias("best_practice_changes")))


#: Audits in JSON, and counts, ids and the answer on the closer.
AUDIT_CASES = [
    ('{"instruction_comparison": {"critical_gaps": [{"id": " a# "}, {"id": "b"}]}, "best_practices_coverage": {"coverage_rows": [{"id": "x", "action_needed": true}, {"id": "y", "action_needed": false}]}, "template_analysis": {"placeholder_patterns_detected": ["p"], "module_checklist_required_closer_present": false}}', 2, "a#,b", 1, "x", "p", "false"),
    ("{}", 0, "", 0, "", "", "true"),
    ('{"template_analysis": {"placeholder_patterns_detected": ["q#", "r"]}}', 0, "", 0, "", "q#,r", "true"),
]


@query(f"SELECT s_suppkey, {_case('s_suppkey', [c[1] for c in AUDIT_CASES], False)}::BIGINT AS gaps, {_case('s_suppkey', [c[2] for c in AUDIT_CASES])} AS gap_ids, {_case('s_suppkey', [c[3] for c in AUDIT_CASES], False)}::BIGINT AS needed, {_case('s_suppkey', [c[4] for c in AUDIT_CASES])} AS needed_ids, {_case('s_suppkey', [c[5] for c in AUDIT_CASES])} AS placeholders, {_case('s_suppkey', [c[6] for c in AUDIT_CASES])} AS closer FROM supplier")
def reference_alignment(spark, sf):
    """What reference audits in JSON say."""
    k = F.col("s_suppkey")
    x = render.reference_alignment(table(spark, sf, "supplier").select("s_suppkey", _pick(k, [c[0] for c in AUDIT_CASES]).alias("json")))
    join = lambda c: F.array_join(c, ",")
    return x.select("s_suppkey", F.col("critical_gap_count").alias("gaps"), join("critical_gap_ids").alias("gap_ids"), F.col("best_practice_action_needed_count").alias("needed"), join("best_practice_action_needed_ids").alias("needed_ids"), join("template_placeholder_patterns_detected").alias("placeholders"), F.col("module_checklist_required_closer_present").cast("string").alias("closer"))

"""Queries that write archives and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from packloom.operators import assets, corpus, manifest, manifest_tree, package_reports
from packloom.plans import convert
from packloom.plans.registry import _case, _pick, query
from packloom.rewrite import chain
from packloom.runtime import materialise, scratch_base, table
from packloom.sources import archive, package, recorded, texts


def _archives(rows):
    """Archives as files (path, content) of (package, path, content) rows."""
    return package.write_packages(rows).select(F.concat(F.lit("d/"), F.col("package").cast("string"), F.lit(".zip")).alias("path"), "content")


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("""SELECT (page_id % 10)::VARCHAR AS package, 'w/p' || page_id || CASE page_id % 3 WHEN 0 THEN '.HTM' ELSE '.html' END AS path, md5(html) AS digest FROM pages""")
def package_round_trip(spark, sf):
    """Pages in archives, read again; other members are left out."""
    k = F.col("page_id")
    p = table(spark, sf, "pages").withColumn("package", (k % 10).cast("string"))
    pages = p.select("package", _text("w/p", k, F.when(k % 3 == 0, ".HTM").otherwise(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    images = p.select("package", _text("w/p", k, ".png").alias("path"), F.encode("url", "UTF-8").alias("content"))
    return package.html_documents(package.members(_archives(pages.unionByName(images)))).select("package", "path", F.md5("html").alias("digest"))


@query("""SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'é' ELSE 'é' END || s_suppkey AS text FROM supplier""")
def decoded_texts(spark, sf):
    """Texts in UTF-8, and in Latin-1 where they are not."""
    k = F.col("s_suppkey")
    bytes_ = F.when(k % 2 == 0, F.encode(_text("é", k), "UTF-8")).otherwise(F.encode(_text("é", k), "ISO-8859-1"))
    return table(spark, sf, "supplier").select("s_suppkey", package.decode_text(bytes_).alias("text"))


def _stored(spark, rows, name: str) -> str:
    """The folder that rows (package, path, content) were written to as archives."""
    at = f"{scratch_base(spark)}/packloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    archive.write_archives(rows, at)
    return at


@query("""SELECT (page_id % 10)::VARCHAR AS package, 'w/p' || page_id || CASE page_id % 3 WHEN 0 THEN '.txt' ELSE '.html' END AS path, octet_length(encode(html)) AS size, md5(html) AS digest FROM pages WHERE page_id % 3 <> 0""")
def archived_pages(spark, sf):
    """Pages written by the archive sink, read by the archive source by ranges; of the
    members only the pages are inflated."""
    k = F.col("page_id")
    rows = table(spark, sf, "pages").select((k % 10).cast("string").alias("package"), _text("w/p", k, F.when(k % 3 == 0, ".txt").otherwise(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    got = archive.read_archives(spark, _stored(spark, rows, "pages"), "*.html", partition_bytes=64 << 10)
    return got.select("package", "path", "size", F.md5("content").alias("digest"))


#: Payloads: addresses in raw and escaped markup, what they become, and how many were
#: rewritten and neutralised.
PAYLOAD_CASES = [
    ("<a href='/d2l/common/dialogs/quickLink/quickLink.d2l?ou=1&amp;type=coursefile&amp;fileId=Week%201%2fa%26b.pdf'>#</a>", "<a href='Week 1/a&amp;b.pdf'>#</a>", 1, 0),
    ('&lt;a href="/d2l/le/content/#/view"&gt;x&lt;/a&gt;', '&lt;a href="@" data-migration-link-status="needs-review" data-migration-original-href="/d2l/le/content/#/view"&gt;x&lt;/a&gt;', 0, 1),
    ('<a href="https://example.org/#">x</a><a href="b.html">y</a>', '<a href="https://example.org/#">x</a><a href="b.html">y</a>', 0, 0),
    ('<a HREF = "/d2l/common/dialogs/quickLink/quickLink.d2l?type=quiz&amp;rcode=#">q</a>', '<a HREF = "@" data-migration-link-status="needs-review" data-migration-original-href="/d2l/common/dialogs/quickLink/quickLink.d2l?type=quiz&amp;amp;rcode=#">q</a>', 0, 1),
    ("<topic>#</topic>", "<topic>#</topic>", 0, 0),
]


@query(f"""SELECT (s_suppkey % 7)::VARCHAR AS package, 'd/news_' || s_suppkey || '_d2l.xml' AS path, replace({_case('s_suppkey', [c[1] for c in PAYLOAD_CASES])}, '@', chr(35)) AS xml, s_suppkey % 5 IN (0, 1, 3) AS changed,
 {_case('s_suppkey', [c[2] for c in PAYLOAD_CASES], False)}::BIGINT AS rewritten, {_case('s_suppkey', [c[3] for c in PAYLOAD_CASES], False)}::BIGINT AS neutralised FROM supplier""")
def d2l_payloads(spark, sf):
    """Payloads of archives, which alone are inflated, and the addresses in them."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").withColumn("package", (k % 7).cast("string"))
    xml = s.select("package", _text("d/news_", k, "_d2l.xml").alias("path"), F.encode(_pick(k, [c[0] for c in PAYLOAD_CASES]), "UTF-8").alias("content"))
    other = s.select("package", _text("d/news_", k, ".xml").alias("path"), F.encode("s_name", "UTF-8").alias("content"))
    got = archive.read_archives(spark, _stored(spark, xml.unionByName(other), "payloads"), "*_d2l.xml")
    return chain.rewrite_payloads(got.select("package", "path", package.decode_text(F.col("content")).alias("xml")))


def _manifests(spark, sf):
    """A manifest for each nation: a module for each supplier, with two items."""
    k = F.col("s_suppkey")
    kid = lambda i, more: _text(f"<item identifier='k{i}-", k, f"' identifierref='r{i}-", k, "'><title> Child ", k, f" &amp; {i} </title>", more, "</item>")
    module = _text("<item identifier='m", k, "' description='&lt;p&gt;d'><title>Module ", k, "</title>", kid(1, "<item><title>deep</title></item>"), kid(2, ""), "</item>")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k, module.alias("x")))), lambda m: m.x), "")
    xml = _text("<manifest xmlns='u:x'><organizations><organization>", body, "</organization></organizations></manifest>")
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("package")).agg(xml.alias("content"))


@query("""WITH s AS (SELECT s_nationkey AS package, s_suppkey AS k, 4 * (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) AS o FROM supplier)
SELECT package, 'm' || k AS item_id, NULL AS parent_id, 0 AS depth, (o + 1)::INT AS ordinal, 'Module ' || k AS title, NULL AS identifierref, '<p>d' AS description FROM s
UNION ALL SELECT package, 'k1-' || k, 'm' || k, 1, (o + 2)::INT, 'Child ' || k || ' & 1', 'r1-' || k, '' FROM s UNION ALL SELECT package, 'item-' || (o + 3), 'k1-' || k, 2, (o + 3)::INT, 'deep', NULL, '' FROM s UNION ALL SELECT package, 'k2-' || k, 'm' || k, 1, (o + 4)::INT, 'Child ' || k || ' & 2', 'r2-' || k, '' FROM s""")
def manifest_items(spark, sf):
    """Items of manifests, in order."""
    return manifest.parse_manifests(_manifests(spark, sf))


@query("""SELECT s_nationkey AS package, 'm' || s_suppkey AS parent_id, 'Child ' || s_suppkey || ' & 1|Child ' || s_suppkey || ' & 2' AS titles FROM supplier""")
def module_children(spark, sf):
    """Titles of the children of each module, in order."""
    kids = manifest.children(manifest.parse_manifests(_manifests(spark, sf)))
    return kids.select("package", "parent_id", F.array_join("titles", "|").alias("titles"))


@query("""SELECT s_nationkey AS package, 'k1-' || s_suppkey AS item_id, 'f1-' || s_suppkey || '.html' AS path FROM supplier""")
def items_with_files(spark, sf):
    """Items joined to the files of their resources."""
    k = F.col("s_suppkey")
    items = manifest.parse_manifests(_manifests(spark, sf))
    s = table(spark, sf, "supplier").withColumn("package", F.col("s_nationkey"))
    resources = s.select("package", _text("r1-", k).alias("identifier"), _text("f1-", k, ".html").alias("href"))
    documents = s.select("package", _text("f1-", k, ".html").alias("path"), F.lit("<p>x</p>").alias("html"))
    return manifest.items_with_files(items, resources, documents).where("html is not null").select("package", "item_id", "path")


@query("""SELECT 'd/' || s_suppkey || '.zip' AS path, CASE s_suppkey % 3 WHEN 0 THEN s_name || chr(10) || 'two & three' WHEN 1 THEN 'x ' || s_name ELSE '' END AS text FROM supplier""")
def document_texts(spark, sf):
    """Paragraphs of documents in Office Open XML."""
    k = F.col("s_suppkey")
    w = "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body>"
    para = lambda *t: _text("<w:p>", *(_text("<w:r><w:t>", x, "</w:t></w:r>") for x in t), "</w:p>")
    name = F.col("s_name")
    xml = _text(w, F.when(k % 3 == 0, _text(para(" ", name), "<w:p/>", para("two &amp;", " three"))).when(k % 3 == 1, para("x ", name)).otherwise("<w:p/>"), "</w:body></w:document>")
    return package.document_texts(_archives(table(spark, sf, "supplier").select(k.alias("package"), F.lit("word/document.xml").alias("path"), F.encode(xml, "UTF-8").alias("content"))))


@query("""SELECT 'd/' || s_suppkey || '.zip' AS path, 0 AS pos, 'Head' AS head, s_name AS cell FROM supplier UNION ALL SELECT 'd/' || s_suppkey || '.zip', 0, 'Second', '' FROM supplier UNION ALL SELECT 'd/' || s_suppkey || '.zip', 1, 'Head', '' FROM supplier UNION ALL SELECT 'd/' || s_suppkey || '.zip', 1, 'Second', s_suppkey::VARCHAR FROM supplier""")
def sheet_cells(spark, sf):
    """Cells of spreadsheets by header."""
    k = F.col("s_suppkey")
    m = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'"
    cell = lambda at, v: f"<c r='{at}' t='inlineStr'><is><t>{v}</t></is></c>"
    sheet = _text(f"<worksheet {m}><sheetData><row>{cell('A1', ' Head ')}{cell('B1', ' ')}{cell('C1', 'Second')}</row><row><c r='A2' t='s'><v>0</v></c>{cell('B2', 'lost')}</row><row><c r='C3'><v>", k, "</v></c></row></sheetData></worksheet>")
    parts = {
        "xl/workbook.xml": F.lit(f"<workbook {m} xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'><sheets><sheet name='One' r:id='r1'/></sheets></workbook>"),
        "xl/_rels/workbook.xml.rels": F.lit("<Relationships><Relationship Id='r1' Target='worksheets/one.xml'/></Relationships>"),
        "xl/sharedStrings.xml": _text(f"<sst {m}><si><t> ", F.col("s_name"), "</t></si></sst>"),
        "xl/worksheets/one.xml": sheet,
    }
    rows = table(spark, sf, "supplier").select(k.alias("package"), F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.encode(x, "UTF-8").alias("content")) for p, x in parts.items()))).alias("x"))
    cells = package.sheet_rows(_archives(rows.select("package", "x.path", "x.content")))
    return cells.select("path", F.col("pos").cast("int").alias("pos"), F.explode("cells").alias("head", "cell"))


@query("""WITH s AS (SELECT s_nationkey AS package, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier),
t AS (SELECT package, k, r, unnest([('Overview', NULL, 1), ('Module ' || k || ': Introduction and Checklist', 'i' || k, 2), ('Activities', NULL, 3), ('Quiz: ' || k, 'q' || k, 4), ('Review', NULL, 5), ('Module ' || k || ': Review', 'v' || k, 6)]) AS x FROM s WHERE k % 2 = 1)
SELECT package, k AS module, x[3] AS position, x[2] AS item_id, x[1] AS title FROM t
UNION ALL SELECT package, k, 1, 'o' || k, 'Overview' FROM s WHERE k % 2 = 0 UNION ALL SELECT package, k, 2, 'p' || k, 'page' FROM s WHERE k % 2 = 0""")
def written_manifests(spark, sf):
    """Manifests parsed, restructured, written and parsed again: the children of each
    module. Headers have names of their own; those of odd modules are made here."""
    k = F.col("s_suppkey")
    item = lambda i, title: _text("<item identifier='", i, k, "' identifierref='r", i, k, "'><title>", title, "</title></item>")
    odd = _text("<item identifier='old", k, "'><title>Review</title></item>", item("v", _text("Chapter ", k, " review")), item("q", _text("Quiz | ", k)), item("i", "Introduction and Objectives"))
    even = _text("<item identifier='o", k, "'><title>Overview</title></item>", item("p", "page"))
    # A header without a reference stays where nothing else changes.
    module = _text("<item identifier='m", k, "'><title>", F.when(k % 2 == 1, "Module ").otherwise("Unit "), k, ": x</title>", F.when(k % 2 == 1, odd).otherwise(even), "</item>")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k, module.alias("x")))), lambda m: m.x), "")
    xml = _text("<manifest xmlns='u:x'><organizations><organization>", body, "</organization></organizations></manifest>")
    manifests = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("package")).agg(xml.alias("content"))
    written = manifest_tree.write_manifests(manifest_tree.restructured(manifest_tree.parse_nodes(manifests), manifest.parse_manifests(manifests)))
    again = materialise(manifest.parse_manifests(written), "again")
    kids = again.where("depth = 1").withColumn("position", F.row_number().over(Window.partitionBy("package", "parent_id").orderBy("ordinal")))
    own = F.when(~F.startswith(F.col("item_id"), F.lit("auto_")), F.col("item_id"))
    return kids.select("package", F.substring("parent_id", 2, 9).cast("long").alias("module"), "position", own.alias("item_id"), "title")


_BASE = "https://x.example"
_FILES = f"{_BASE}/api/v1/courses/' || course || '/files?per_page=100"


def _answers(spark, sf):
    """Lists of files of courses, ten to a page, as a course system answers: of every third
    course the last page names one that was not recorded, and of the next an answer is 404."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 30).alias("course"), F.col("o_orderkey").alias("k"))
    o = o.withColumn("r", F.row_number().over(Window.partitionBy("course").orderBy("k")) - 1).withColumn("page", F.floor(F.col("r") / 10))
    pages = o.groupBy("course", "page").agg(F.to_json(F.transform(F.sort_array(F.collect_list("k")), lambda k: F.struct(_text("f", k).alias("display_name"), k.alias("id")))).alias("body"))
    pages = pages.withColumn("end", F.max("page").over(Window.partitionBy("course")) == F.col("page"))
    first = _text(_BASE, "/api/v1/courses/", F.col("course"), "/files?per_page=100")
    at = lambda n: F.concat(first, F.when(n > 0, _text("&page=", n)).otherwise(""))
    more = ~F.col("end") | (F.col("course") % 3 == 1)
    link = F.when(more, _text("<", first, '>; rel="first",<', at(F.col("page") + 1), '>; rel="next"'))
    gone = (F.col("course") % 3 == 2) & F.col("end")
    return pages.select(at(F.col("page")).alias("url"), F.lit(1).cast("long").alias("at"), F.when(gone, 404).otherwise(200).alias("status"), link.alias("link"), F.when(gone, '{"message": "gone"}').otherwise(F.col("body")).alias("body"))


_LISTED = """r AS (SELECT o_custkey % 30 AS course, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey) - 1 AS r FROM orders),
e AS (SELECT *, r // 10 AS page, max(r // 10) OVER (PARTITION BY course) AS last FROM r)"""


@query(f"WITH {_LISTED} SELECT course::VARCHAR AS course, 'files' AS kind, page, (r % 10)::INT AS pos, 'f' || k AS name FROM e WHERE course % 3 <> 2 OR page < last")
def recorded_items(spark, sf):
    """Items of recorded lists, page after page."""
    wanted = recorded.requests(spark, _BASE, [str(i) for i in range(30)], ("files",))
    got = recorded.items(_answers(spark, sf), wanted, strict=False)
    return got.select("course", "kind", "page", "pos", F.get_json_object("item", "$.display_name").alias("name"))


@query(f"""WITH {_LISTED}, l AS (SELECT course, any_value(last) AS last FROM e GROUP BY course)
SELECT course::VARCHAR AS course, last + 1 AS page, 'not recorded: {_FILES}&page=' || (last + 1) AS error FROM l WHERE course % 3 = 1 UNION ALL SELECT course::VARCHAR, last, 'HTTP 404: gone' FROM l WHERE course % 3 = 2""")
def recorded_failures(spark, sf):
    """What went wrong in recorded lists."""
    wanted = recorded.requests(spark, _BASE, [str(i) for i in range(30)], ("files",))
    return recorded.failures(_answers(spark, sf), wanted).select("course", "page", "error")

@query("""WITH p AS (SELECT page_id, (page_id % 5)::VARCHAR AS package, html, 'data:image/png;base64,' || to_base64(encode('hot' || page_id % 5)) AS hot, CASE WHEN page_id % 4 <> 0 THEN 'data:image/jpeg;base64,' || to_base64(encode(url)) END AS own FROM pages)
SELECT package, 'w/p' || page_id || '.html' AS path, md5('<img src="' || hot || '"><img src=' || chr(39) || coalesce(own, 'i/p' || page_id || '.jpg') || chr(39) || '><img src="none.png"><img src="' || hot || '">' || html) AS digest,
 3 - (page_id % 4 = 0)::BIGINT AS embedded, (page_id % 4 = 0)::BIGINT AS too_large FROM p""")
def embedded_images(spark, sf):
    """Pages with their images in them: one that all pages of a package have, and one
    each, of which some are too large."""
    k = F.col("page_id")
    p = table(spark, sf, "pages").withColumn("package", (k % 5).cast("string"))
    own = _text("i/p", k, ".jpg")
    html = _text('<img src="../Hot.PNG"><img src=\'', own, '\'><img src="none.png"><img src="/hot.png?v=1">', F.col("html"))
    pages = p.select("package", _text("w/p", k, ".html").alias("path"), html.alias("html"))
    content = F.when(k % 4 == 0, F.repeat("url", 100)).otherwise(F.col("url"))
    images = p.select("package", F.concat(F.lit("w/"), own).alias("path"), F.encode(content, "UTF-8").alias("content"))
    hot = p.select("package", F.lit("hot.png").alias("path"), F.encode(_text("hot", F.col("package")), "UTF-8").alias("content")).distinct()
    got = assets.embed(pages, images.unionByName(hot), image_bytes=1000)
    return got.select("package", "path", F.md5("html").alias("digest"), "embedded", "too_large")

@query("""WITH f AS (SELECT s_nationkey AS p, s_suppkey AS k, lpad(s_suppkey::VARCHAR, 9, '0') AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'R' || s_suppkey % 3 END AS m, CASE WHEN s_suppkey % 5 = 0 THEN 'Alt' END AS a FROM supplier),
t AS (SELECT p, count(*) AS n, count(*) FILTER (k % 4 = 0) AS c, count(m) AS mm, count(a) AS aa FROM f GROUP BY p),
r AS (SELECT p, 0 AS kind, m AS reason, count(*) AS n, min(path) AS first FROM f WHERE m IS NOT NULL GROUP BY p, m UNION ALL SELECT p, 1, a, count(*), min(path) FROM f WHERE a IS NOT NULL GROUP BY p, a),
g AS (SELECT p, kind, '### ' || CASE kind WHEN 0 THEN 'Manual Review' ELSE 'Accessibility' END || ' Reasons' || chr(10) || chr(10) || string_agg('- [ ] (' || n || ') ' || reason || chr(10), '' ORDER BY n DESC, first) || chr(10) AS x FROM r GROUP BY p, kind),
s AS (SELECT p, string_agg(x, '' ORDER BY kind) AS x FROM g GROUP BY p)
SELECT t.p::VARCHAR AS package, md5('# Migration Preflight Checklist' || chr(10) || chr(10) || '- Input zip: `' || t.p || '.zip`' || chr(10) || '- Output zip: `out`' || chr(10) || '- Policy profile: `strict`' || chr(10) || '- Profile description: Strict' || chr(10) || chr(10) || '## Automated Summary' || chr(10) || chr(10)
 || '- HTML files scanned: ' || n || chr(10) || '- HTML files changed: ' || c || chr(10) || '- Manual review issues: ' || mm || chr(10) || '- Accessibility issues: ' || aa || chr(10) || chr(10) || '## Required Verifications Before Release' || chr(10) || chr(10) || '- [ ] One' || chr(10) || '- [ ] Two' || chr(10) || chr(10)
 || '## Findings-Based Follow-Up' || chr(10) || chr(10) || coalesce(left(x, length(x) - 1), '- [ ] No issues flagged by automation.' || chr(10))) AS digest FROM t LEFT JOIN s ON s.p = t.p""")
def preflight_files(spark, sf):
    """Checklists of packages, written a file each and read again."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").withColumn("package", F.col("s_nationkey").cast("string"))
    found = lambda cond, reason: F.when(cond, F.array(F.struct(reason.alias("reason"), F.lit("e").alias("evidence"))))
    changes = F.lit(None).cast("array<struct<category:string,description:string,count:int>>")
    files = s.select("package", F.lpad(k.cast("string"), 9, "0").alias("path"), (k % 4 == 0).alias("changed"), changes.alias("changes"), found(k % 2 == 0, _text("R", k % 3)).alias("manual"), found(k % 5 == 0, F.lit("Alt")).alias("accessibility"))
    packages = s.select("package", _text(F.col("package"), ".zip").alias("input"), F.lit("out").alias("output"), F.lit("strict").alias("profile")).distinct()
    profiles = spark.createDataFrame([("strict", "Strict", ["One", "Two"])], "profile string, description string, items array<string>")
    lines = package_reports.preflight_checklists(packages, files, profiles)
    at = f"{scratch_base(spark)}/packloom/{spark.sparkContext.applicationId}/checklists-{uuid.uuid4().hex}"
    texts.write_texts(lines, at, package_reports.ORDER)
    got = spark.read.text(at, wholetext=True)
    return got.select(F.regexp_extract(F.input_file_name(), r"([^/]*)\.md$", 1).alias("package"), F.md5("value").alias("digest"))

@query("""WITH k AS (SELECT s_suppkey AS k FROM supplier)
SELECT CASE k % 5 WHEN 0 THEN 'FOLDER-' || k WHEN 1 THEN 'Name of c' || k || 'x' WHEN 2 THEN 'id' || k || '.q' WHEN 3 THEN 'zz ' || (30000 + k) || '9' ELSE 'none' || k END AS course,
 CASE WHEN k % 5 < 4 THEN 'd/folder ' || k || '/canvas-course-' || k || '.snapshot.json' END AS snapshot, CASE k % 5 WHEN 0 THEN 'token' WHEN 1 THEN 'contains' WHEN 2 THEN 'token' WHEN 3 THEN 'number' END AS how FROM k""")
def snapshot_keys(spark, sf):
    """Courses to snapshots by the keys that each has: folder, code, name and id."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    s = table(spark, sf, "supplier")
    told = F.to_json(F.struct(_text("id", k, "Q").alias("course_id"), F.struct(_text("code ", k + 30000).alias("course_code"), _text("The Name of C", k, "x, all").alias("name")).alias("course")))
    files = s.where(k % 5 < 4).select(_text("d/folder ", n, "/canvas-course-", n, ".snapshot.json").alias("path"), F.when(k % 5 == 0, "no json").otherwise(told).alias("content"))
    course = F.when(k % 5 == 0, _text("FOLDER-", k)).when(k % 5 == 1, _text("Name of c", k, "x")).when(k % 5 == 2, _text("id", k, ".q")).when(k % 5 == 3, _text("zz ", k + 30000, "9")).otherwise(_text("none", k))
    return corpus.match_snapshots(s.select(course.alias("course")), corpus.snapshot_index(files)).select("course", "snapshot", "how")

@query(f"""WITH p AS (SELECT page_id AS k, 'w/' || page_id || '.html' AS path FROM pages), d AS (SELECT * FROM p WHERE k % 3 = 0)
SELECT path, CASE WHEN k % 3 <> 0 THEN 'kept' WHEN k % 2 = 0 THEN 'updated' ELSE 'unchanged' END AS status, CASE WHEN k % 3 = 0 THEN k % 2 = 0 END AS edited_body_changed,
 '<body>' || chr(10) || CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN '<p>new ' || k || ' <a href="{'#'}" data-migration-link-status="needs-review" data-migration-original-href="/d2l/le/' || k || '">x</a></p>' ELSE '<p>old ' || k || '</p>' END || chr(10) || '</body>' AS html,
 CASE WHEN k % 3 = 0 THEN (k % 2 = 0)::BIGINT END AS sanitizer_changes, CASE WHEN k % 3 = 0 THEN 0::BIGINT END AS best_practice_changes FROM p
UNION ALL SELECT 'gone/' || k, 'missing', NULL, NULL, NULL, NULL FROM p WHERE k % 10 = 0""")
def review_write_back(spark, sf):
    """Drafts of a reviewer, written back through the chain."""
    k = F.col("page_id")
    p = table(spark, sf, "pages").select(k, _text("w/", k, ".html").alias("path"), _text("<body>\n<p>old ", k, "</p>\n</body>").alias("html"))
    old = _text("<p>old ", k, "</p>")
    new = F.when(k % 2 == 0, _text(" <p>new ", k, ' <a href="/d2l/le/', k, '">x</a></p>\n')).otherwise(old)
    drafts = p.where(k % 3 == 0).select("path", old.alias("original_body_html"), new.alias("edited_body_html"))
    drafts = drafts.unionByName(p.where(k % 10 == 0).select(_text("gone/", k).alias("path"), F.lit("a").alias("original_body_html"), F.lit("b").alias("edited_body_html")))
    got = convert.write_back(p.select("path", "html"), drafts, [], convert.Profile("any"))
    return got.select("path", "status", "edited_body_changed", "html", "sanitizer_changes", "best_practice_changes")

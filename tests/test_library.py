import io
import zipfile

import pytest
from pyspark.sql import functions as F

from packloom.functions import arrow, html
from packloom.operators import cohort, detect, findings, manifest, metrics, practice, resolve, rules, sets
from packloom.rewrite import chain
from packloom.rewrite.tags import Tag, find_close, parse_style
from packloom.sources import package
from packloom.streaming.findings import findings_by_window, page_stream


def column(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_scalars(spark):
    assert column(spark, html.style_map, "Color: Red; color:blue; bad; a: b:c;", "") == [{"color": "blue", "a": "b:c"}, {}]
    assert column(spark, html.slug, "A & B -- c!") == ["a-b-c"]
    assert column(spark, html.is_local, "a/b.html", "/x", "http://x", "#a", "mailto:x", "") == [True, False, False, False, False, False]
    assert column(spark, html.references, "<a href='x'><img SRC=\"y\">") == [["x", "y"]]
    assert column(spark, arrow.unescape, "&amp;amp;lt;", None) == ["<", None]
    assert column(spark, arrow.normal_path, "../a/./b%20c.html", ".hid") == ["a/b c.html", "hid"]
    assert html.java_pattern(r"(?P<a>x)(?P=a)", "i") == r"(?i)(?<a>x)\k<a>" and html.java_replacement(r"$\1\g<a>") == r"\$$1${a}"


def test_rules(spark):
    r = rules.load_rules('{"replacements": [{"description": "d", "pattern": "(?P<w>b)b", "replacement": "<\\\\g<w>>"}], "link_rewrites": [{"description": "l", "from": "aa", "to": "a"}], "manual_review_triggers": [{"reason": "t", "pattern": "C", "flags": "i"}], "banner": {"enabled": true, "html": "<b>B</b>"}}')
    df = spark.createDataFrame([("aaabbbb c",), (None,)], "html string")
    df = rules.apply_rewrites(rules.apply_replacements(df, r.replacements), r.rewrites)
    got = df.withColumn("t", rules.triggered(F.col("html"), r.triggers)).collect()
    assert got[0].html == "aa<b><b> c" and [tuple(c) for c in got[0].changes] == [("replacement", "d", 2), ("link_rewrite", "l", 1)]
    assert [tuple(x) for x in got[0].t] == [("t", "c")]
    page = spark.createDataFrame([("<html><BODY x>y",), ("<b>b</B>",)], "html string")
    assert [r.html for r in rules.apply_banner(page, r.banner).collect()] == ["<html><BODY x>\n<b>B</b>\ny", "<b>b</B>"]


def test_detectors(spark):
    page = "<h1>a</h1><h3>b</h3><img src=x><img alt=''><img alt='' role=\"presentation\"><table><tr></table><a>Here</a><a>there</a>"
    got = [x.reason for x in column(spark, detect.accessibility, page)[0]]
    assert got == ["Image missing alt attribute", "Image alt attribute is empty", "Heading level jump detected", "Table missing caption", "Non-descriptive link text"]
    tags = column(spark, lambda c: detect.layout_intent(c), '<div style="width: 500px">', '<div style="width:501px; FLOAT:Left">', "<div>")
    assert [(t.has_fixed_width, t.fixed_width_px, t.has_float) for t in tags] == [(False, None, False), (True, 501, True), (False, None, False)]


def test_resolution(spark):
    paths = spark.createDataFrame([("a/X_one.html",), ("b/Y_one.html",), ("a/two.html",), ("c/Z_three.html",)], "path string")
    refs = spark.createDataFrame([("a/two.html", "a"), ("A/TWO.html", "q"), ("z/two.html", "q"), ("one.html", "a"), ("one.html", "q"), ("three.html", "q"), ("no.html", "a")], "ref string, page_dir string")
    got = [r.arm for r in resolve.resolve_paths(refs, paths).orderBy(F.monotonically_increasing_id()).collect()]
    assert sorted(got) == sorted(["exact", "casefold", "basename", "same_dir_tail", "missing", "cross_dir_tail", "missing"])


def test_practice(spark):
    raw = spark.createDataFrame([(1, "q lib", "Use banks", ""), (2, " Q  LIB", "use  banks", ""), (3, "q lib", "avoid banks", ""), (4, "", "", "")], "n int, `D2L Feature` string, `Best Practice` string, Notes string")
    rows = practice.practice_rows(raw, "n")
    assert [r.row_number for r in rows.orderBy("row_number").collect()] == [2, 3, 4]
    dup = practice.duplicates(rows, practice.fingerprint("source", "recommendation", "target", "notes", "category"), "row_number").collect()
    assert [(d.n, d.excess, d.first_row) for d in dup] == [(2, 1, 2)]
    con = practice.conflicts(rows, F.col("source"), F.col("recommendation")).collect()
    assert [(c.source_key, c.n_rows, c.n_advice) for c in con] == [("q lib", 3, 2)]


def test_checklist(spark):
    issues = spark.createDataFrame([("p1", "accessibility", 0, "Table missing caption", ""), ("p2", "manual", 0, "LTI tool embed (yuja) — x", "")], "path string, type string, pos int, reason string, evidence string")
    rows = {r.category: r for r in findings.review_checklist(issues).collect()}
    assert rows["a11y_table_caption"].priority == "P2" and "Yuja" in rows["lti_embed_reconfiguration"].action
    imports = spark.createDataFrame([("Import Error: Quiz - q", "u")], "description string, reference string")
    every = findings.checklist(findings.review_checklist(issues), findings.import_checklist(imports), findings.standard_tasks(spark)).collect()
    assert len(every) == 9 and every[0].priority == "P1" and findings.top_reasons(issues).count() == 2


def test_titles_of_other_alphabets(spark):
    """F2, F3, F4, F5, F8: what is left of both texts is empty, which is no repetition."""
    pages = spark.createDataFrame([("<title>Ç Ç</title><h1>Ç Ç</h1>",), ("<title>Ç</title><p>x</p>",), ("<title>Ç a</title><h1>É A</h1>",), ("<title>a &amp; b</title><h1>A and B</h1>",)], "html string")
    assert [r[0] for r in pages.select(metrics.title_repeated(F.col("html"))).collect()] == [False, False, True, True]
    pairs = pages.select(F.lit("p").alias("path"), F.lit("").alias("original"), F.col("html").alias("converted"))
    assert [r[0] for r in metrics.visual_audit(pairs).select("duplicate_title_first_block").collect()] == [True, False, True, True]


def test_sets_and_cohorts(spark):
    a = spark.createDataFrame([("x" * 30 + "\nshort",)], "t string")
    b = spark.createDataFrame([("Y" * 30,)], "t string")
    assert {(r.line[0], r.side) for r in sets.line_gap(sets.lines(a, "t"), sets.lines(b, "t")).collect()} == {("x", "missing"), ("y", "extra")}
    rows = [("p", "module", f"Module {i}") for i in range(4)] + [("p", "page", "Introduction and Checklist")] * 2 + [("p", "page", "Learning Activities")] * 2
    f = cohort.snapshot_features(spark.createDataFrame(rows, "package string, kind string, title string"))
    assert f.select(cohort.structure_cohort()).first()[0] == "template-module" and f.first().module_style_ratio == 1.0


def test_manifest(spark):
    x = "<manifest xmlns='u'><organizations><organization><item identifier='a'><title>Module 1: Cells</title><item identifier='b' identifierref='r'><title>Quiz</title></item><item><title>Introduction</title></item></item></organization></organizations></manifest>"
    items = manifest.parse_manifests(spark.createDataFrame([("p", x), ("q", "<broken"), ("r", None)], "package string, content string")).cache()
    assert [(r.title, r.depth, r.parent_id) for r in items.orderBy("ordinal").collect()] == [("Module 1: Cells", 0, None), ("Quiz", 1, "a"), ("Introduction", 1, "a")]
    got = [(r.title, r.is_header) for r in manifest.restructure(items).orderBy("position").collect()]
    assert got == [("Overview", True), ("Module 1: Introduction and Checklist", False), ("Activities", True), ("Quiz: [Title Here]", False)]
    assert column(spark, manifest.topic_to_module, "Topic 07 | x") == ["Module 7: x"] and column(spark, manifest.normal_delimiters, "Quiz 1 | y", "Other | z") == ["Quiz 1: y", "Other | z"]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<title>Alpha</title><p>The Alpha</p><p>b</p>", "<p>b</p>"),
        ("<h1 id=x>t</h1>", "<h2 id=x>t</h2>"),
        ("<p>&nbsp;</p><p></p>", "<p>&nbsp;</p><p></p>"),
        ("<div><span> </span></div>x", "x"),
        ('<table style="width:500px"></table>', '<table style="width:500px"></table>'),
        ('<p class="row a">x</p>', '<p class="a">x</p>'),
        ('<p style="--d2l-x: 1; color: red">x</p>', '<p style="color: red;">x</p>'),
        ('<a href="/content/enforced/a">x</a>', '<a href="#" data-migration-link-status="needs-review" data-migration-original-href="/content/enforced/a">x</a>'),
    ],
)
def test_chain(page, want):
    assert chain.run(page)[0] == want


def test_chain_parts(spark):
    assert chain.repair_headings("<h1>a</h1><h4>b</h4><h4>c</h4>") == ("<h1>a</h1><h2>b</h2><h3>c</h3>", 2)
    assert chain.new_tab_links('<a href="http://x">')[0] == '<a href="http://x" target="_blank" rel="noopener noreferrer">'
    card = '<div class="card"><div class="card-header">{}</div><div class="collapse"><div class="card-body"><div>b</div></div></div></div>'
    assert chain.run(card.format("Section"), policy=chain.Policy(accordion="flatten"))[0] == "<div><div>b</div></div>"
    assert chain.run(card.format("Goals"), "syllabus.html")[0] == "<h3>Goals</h3>\n<div><div>b</div></div>"
    out, notes = chain.run('<div style="display:flex; gap:1px; float:right">x</div>')
    assert 'style="display: block; float: right;"' in out and out.startswith('<div class="migration-clearfix"') and len(notes) == 2
    assert find_close("<div><div></div></div>x", "div", 5) == 22 and parse_style("a:b;;c") == {"a": "b"}
    t = Tag("<img alt='a > b' src=x />")
    t.set("src", 'q"')
    assert t.text == "<img alt='a > b' src=\"q&quot;\" />" and t.get("alt") == "a > b"
    df = spark.createDataFrame([("a.html", "<h1>x</h1>"), ("b.html", None)], "path string, html string")
    got = {r.path: r for r in chain.sanitise(df).collect()}
    assert got["a.html"].html == "<h2>x</h2>" and got["a.html"].changes[0]["count"] == 1 and got["b.html"].html == ""


def test_packages(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("b/x.HTML", "é".encode())
        z.writestr("a.htm", "é".encode("latin-1"))
        z.writestr("c.png", b"\0")
    (tmp_path / "one.zip").write_bytes(buf.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no")
    pk = package.read_packages(spark, str(tmp_path)).cache()
    assert pk.count() == 3 and {r.html for r in package.html_documents(pk).collect()} == {"é"}
    again = zipfile.ZipFile(io.BytesIO(bytes(package.write_packages(pk).first().content)))
    assert again.namelist() == ["a.htm", "b/x.HTML", "c.png"]


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿A,B\n1,\n", encoding="utf-8")
    assert [tuple(r) for r in package.read_table(spark, str(tmp_path / "t.csv")).collect()] == [("1", "")]
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>H</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {m}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>K</t></is></c></row><row><c r="A2"><v>7</v></c></row></sheetData></worksheet>')
    assert [r.asDict() for r in package.read_table(spark, str(tmp_path / "t.xlsx")).collect()] == [{"H": "7", "K": ""}]
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>a</w:t><w:t>b</w:t></w:p><w:p/></w:document>')
    assert package.read_documents(spark, str(tmp_path)).first().text == "ab"


def test_stream(spark, tmp_path):
    rows = [("p", "<img src=x><a>here</a>", "2024-01-01 00:00:00"), ("q", "<img src=y>", "2024-01-01 00:05:00")]
    df = spark.createDataFrame(rows, "path string, html string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    q = findings_by_window(page_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("found").outputMode("complete").start()
    q.processAllAvailable()
    got = {r.reason: r.n for r in spark.table("found").collect()}
    q.stop()
    assert got == {"Image missing alt attribute": 2, "Non-descriptive link text": 1}


def test_best_practice_and_payloads():
    page = "<h2>Module Checklist</h2><ul><li>a<ul><li>b</li></ul></li></ul>"
    out, n, _ = chain.checklist_closer(page)
    # The reminder goes before the first end of a list after the heading.
    assert n == 1 and out == page.replace("</ul>", f"\n  <li>{chain.CLOSER}</li></ul>", 1) and chain.checklist_closer(out) == (out, 0, 0)
    assert chain.checklist_closer("<body>x</body>", "introduction and checklist.html")[0].endswith("</p>\n</body>")
    text, rewritten, neutral = chain.payload_hrefs('href="/d2l/a" href="/d2l/common/dialogs/quicklink/quicklink.d2l?type=coursefile&amp;fileId=x.pdf" href="y"')
    assert (rewritten, neutral) == (1, 1) and 'href="x.pdf"' in text and 'href="y"' in text
    assert chain.relink('<img src=a.png><a href="b">', {"a.png": "/f/1"}) == ('<img src="/f/1"><a href="b">', 1)


def test_convert(spark):
    from packloom.plans import convert

    text = '{"profiles": {"a": {"sanitize_brightspace_assets": false, "preflight_items": [" x ", ""]}}}'
    p = convert.profile("a", text)
    assert not p.sanitize_brightspace_assets and p.require_mc_closing_bullet and p.preflight_items == ("x",)
    with pytest.raises(ValueError):
        convert.profile("b", text)
    pages = spark.createDataFrame([("a.html", '<h1>T</h1><a href="http://x">here</a>'), ("b.html", "plain"), ("c.html", None)], "path string, html string")
    config = rules.Rules([rules.Replacement("r", "T", "U")], [], [rules.Trigger("t", "U")])
    got = {r.path: r for r in convert.convert(pages, config, p, best_practice=True).collect()}
    assert got["a.html"].changed and [c["count"] for c in got["a.html"].changes] == [1, 1, 1] and "<h2>U</h2>" in got["a.html"].html
    assert [x.reason for x in got["a.html"].manual] == ["t"] and [x.reason for x in got["a.html"].accessibility] == ["Non-descriptive link text"]
    assert not got["b.html"].changed


def test_snapshots_hold_tokens_without_numbers(spark):
    from packloom.operators import corpus

    courses = spark.createDataFrame([("BIO-Lab",), ("ab",), ("MATH 2001",), ("Art History",), ("zzz",), ("--",)], "course string")
    snaps = spark.createDataFrame([("s1", "Fall BIO Lab"), ("s2", "Grab Bag"), ("s3", "MATH2001x of spring"), ("s4", "art history"), ("s5", "Art History II")], "snapshot string, name string")
    got = {r.course: (r.snapshot, r.how) for r in corpus.match_snapshots(courses, snaps).collect()}
    assert got == {"BIO-Lab": ("s1", "contains"), "ab": ("s1", "contains"), "MATH 2001": ("s3", "contains"), "Art History": ("s4", "token"), "zzz": (None, None), "--": (None, None)}


def test_conversion_is_one_stage_of_workers(spark):
    """chain and best practice share a worker, which does not hold the page twice."""
    from packloom.plans import convert

    pages = spark.createDataFrame([(f"p{i}", f"<h2>a</h2><h4>{i}</h4><h1>x</h1>") for i in range(150)] + [("q", None), ("r", "<p>x</p>")], "path string, html string")
    got = convert.convert(pages, rules.Rules([], [], []), convert.Profile("any"), best_practice=True)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = {r.path: (r.html, r.changed, [c["category"] for c in r.changes]) for r in got.collect()}
    assert rows["p7"] == ("<h2>a</h2><h3>7</h3><h2>x</h2>", True, ["sanitizer", "best_practice"]) and len(rows) == 152
    assert rows["q"] == ("", True, []) and rows["r"] == ("<p>x</p>", False, [])


def test_texts_meet_parts_of_keys_not_keys(spark):
    """rows grow with the characters of different keys, not with links times targets."""
    keys = spark.createDataFrame([("a b survey",), ("xa b",), ("",), (None,)], "key string")
    texts = spark.createDataFrame([("a b",), ("b survey",), ("zz",), ("",), (None,)], "text string")
    got = sorted((r.key, r.part) for r in html.held_parts(keys, "key", texts, "text").collect())
    assert got == [("a b survey", "a b"), ("a b survey", "b survey"), ("xa b", "a b")]
    links = spark.createDataFrame([(i, "a b") for i in range(300)], "link_id long, text string")
    targets = spark.createDataFrame([("xa b", f"u/{i:03}") for i in range(300)], "key string, url string")
    best = resolve.best_targets(links, targets)
    assert {(r.url, r.score) for r in best.collect()} == {("u/299", 80)} and best.count() == 300
    # Nothing that grows with the tables is planned as a broadcast.
    assert "Broadcast" not in best._jdf.queryExecution().executedPlan().toString()


def test_snapshots_by_their_place_in_the_listing(spark):
    """the first of the listing counts, whatever its name."""
    from packloom.operators import corpus

    courses = spark.createDataFrame([("sec 1101",), ("zz 5555",), ("yy 6666",)], "course string")
    snaps = spark.createDataFrame([(2, "s10013", "Fall sec 11013 x"), (1, "s101", "Fall sec 1101 x"), (3, "t", "a 5555 6666"), (4, "u", "b 6666")], "pos int, snapshot string, name string")
    got = lambda df: {r.course: (r.snapshot, r.how) for r in corpus.match_snapshots(courses, df).collect()}
    rest = {"zz 5555": ("t", "number"), "yy 6666": (None, None)}
    assert got(snaps) == {"sec 1101": ("s101", "contains")} | rest
    assert got(snaps.drop("pos")) == {"sec 1101": ("s10013", "contains")} | rest


def test_suggested_targets_follow_both_ladders(spark):
    from packloom.operators import links

    quick, content = "/d2l/common/quickLink.d2l?ou=1&type=survey", "/d2l/le/content/1/viewContent/2"
    rows = [(1, quick, "Week 1"), (2, quick, "course eval"), (3, quick, "Fin"), (4, quick, "Unit 3 quiz extra"), (5, content, "Syllabus"), (6, content, "Course syllabus"), (7, quick, "dterm"), (8, "https://x.y/z", "Week 1"), (9, quick, "!")]
    df = spark.createDataFrame([(p, 0, o, t) for p, o, t in rows], "page long, pos int, original string, link_text string")
    tests = [("Week 1 Quiz", "w/quiz"), ("Week 1 Survey", "w/survey"), ("Week 1 Survey of all", "w/z"), ("Course Eval Quiz", "c/quiz"), ("Course Eval forms", "c/z"), ("Finals", "f/1"), ("Midterm", "m/1"), ("Unit 3 quiz", "u/1")]
    pages = [("Syllabus", "p/z"), ("Syllabus F2F", "p/zz"), ("Syllabus Online", "p/online"), ("Syllabus for Spring", "p/spring"), ("Online f2f", "p/zzz")]
    targets = [spark.createDataFrame(x, "title string, url string") for x in (pages, tests)]
    got = {r.page: r.suggested for r in links.suggest_targets(df, *targets, "page").collect()}
    assert got == {1: "w/survey", 2: "c/quiz", 3: "f/1", 4: "", 5: "p/online", 6: "", 7: "m/1", 8: "", 9: ""}

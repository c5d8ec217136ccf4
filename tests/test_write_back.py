from packloom.operators import render, review, rules
from packloom.plans import convert
from pyspark.sql import functions as F

PROFILE = convert.Profile("p", require_mc_closing_bullet=False)


def test_bodies(spark):
    cases = [
        ("<html><body class='x'>old</body></html></body>", "  new \n", "<html><body class='x'>\nnew\n</body></html></body>"),
        ("<body>old</BODY>", " ", "<body>\n</BODY>"),
        ("no body", " $1 \\x ", "$1 \\x"),
        ("<body>a", "b", "b"),
    ]
    got = spark.createDataFrame([c[:2] for c in cases], "h string, b string").select(review.with_body(F.col("h"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [c[2] for c in cases]


def test_drafts_go_through_the_chain(spark):
    pages = [("w/a.html", "<body>a</body>"), ("w/b.html", "<body>\nsame\n</body>"), ("w/c.html", "<body>c</body>"), ("w/d.html", "<body>d</body>")]
    drafts = [
        ("w\\a.html ", "a", '<p>x <a href="/d2l/le/content/1/view">old</a> <a href="https://e.org/">out</a></p><img src="i.png"><script>1</script>'),
        ("w/b.html", " same", "same"), ("gone.html", "x", "y"), ("w/d.html", None, None),
    ]
    df = convert.write_back(spark.createDataFrame(pages, "path string, html string"), spark.createDataFrame(drafts, "path string, original_body_html string, edited_body_html string"), [rules.Trigger("Script", "<script", "i")], PROFILE, best_practice=True)
    got = {r.path: r for r in df.collect()}
    assert {k: r.status for k, r in got.items()} == {"w/a.html": "updated", "w/b.html": "unchanged", "w/c.html": "kept", "gone.html": "missing", "w/d.html": "updated"}
    a = got["w/a.html"]
    assert 'data-migration-link-status="needs-review"' in a.html and 'target="_blank"' in a.html and a.edited_body_changed and not got["w/b.html"].edited_body_changed
    assert a.sanitizer_changes >= 1 and a.best_practice_changes >= 1 and any(i.reason == "Script" for i in a.manual) and len(a.accessibility) >= 1
    assert got["w/c.html"].html == "<body>c</body>" and got["w/d.html"].html == "<body>\n</body>" and got["gone.html"].html is None
    t = render.write_back_totals(df.where("status <> 'kept'")).first()
    assert (t.draft_pages, t.pages_updated, t.pages_missing) == (4, 2, 1) and t.sanitizer_changes == a.sanitizer_changes

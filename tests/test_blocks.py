"""Blocks of pages by their neighbours, and the label rules in Python and natively."""

import time

import pytest
from pyspark.sql import functions as F

from packloom.operators import overlay as rules
from packloom.plans.template_queries import ICON_CASES, LABEL_CASES
from packloom.rewrite import blocks, overlay

T = overlay.Template({}, {}, rules.DEFAULT_LABELS)
IMG = '<img src="TemplateAssets/{}" alt="">'


def page(text, path="a.html", t=T):
    notes = overlay.Counter()
    out = overlay.page_headings(overlay.merge_blocks(text, path, t, notes), path, t, notes)
    return out, notes


def test_rules_agree_in_python_and_spark(spark):
    for label, icon, want in LABEL_CASES:
        assert overlay.heading_label(label, overlay.base_name(icon)) == want
    for icon, label, title, want in ICON_CASES:
        assert overlay.semantic_icon(icon, label, title) == want
    words = [(i, a, b) for i in ("a.png", "view.png", "rocket.png") for a in ("", "View", "Read &amp; do", "Main Point") for b in ("", " ", "Q and A", "Course Q and A")]
    rows = spark.createDataFrame(words, "i string, a string, b string").select("*", rules.semantic_icon(F.col("i"), F.col("a"), F.col("b")).alias("s"), rules.heading_label(F.col("a"), F.col("i")).alias("l")).collect()
    for r in rows:
        assert r.s == overlay.semantic_icon(r.i, r.a, r.b) and r.l == overlay.heading_label(r.a, r.i)


def test_stream():
    s = blocks.Stream("<p>a</p> <P class='x'>&nbsp;<b></b></p>\n<h2>t</h2>")
    assert s.name == ["p", "/p", "p", "b", "/b", "/p", "h2", "/h2"]
    assert s.close(0) == 1 and s.close(2) == 5 and s.close(3) == 4 and s.empty(2, {"p"}) == 6 and s.empty(0, {"p"}) is None
    assert s.attrs(2) == " class='x'" and s.heading(6) == 7 and s.body(6, 7) == "t"


@pytest.mark.parametrize("n", [2, 3])
def test_adjacent_icon_blocks(n):
    icons = "".join(f"<p>&nbsp;{IMG.format(f'{i}.png')}</p>" for i in range(n))
    out, notes = page(icons + "<p>Words here</p>")
    # In the first pass the first block takes the second for its text and stays, as that has
    # no words. A third one meets the words, and the second then meets their heading.
    assert notes[overlay.MERGED] == (2 if n == 3 else 0)
    assert ("<strong>Words here</strong>" in out) == (n == 3)
    out, notes = page(icons + "<h4>Words here</h4>")
    assert notes[overlay.MERGED] == 1 and out.count("<p>") == n - 1 and "<strong>Words here</strong></h3>" in out


def test_merges_once_per_pair():
    pair = f"<p>{IMG.format('a.png')}</p>\n<h2>T1</h2>"
    out, notes = page(pair * 3)
    assert notes[overlay.MERGED] == 3 and out.count("<h2") == 3 and "<p>" not in out
    out, notes = page(f"<p>{IMG.format('a.png')}</p>text<h2>T1</h2>")
    assert not +notes and out.endswith("text<h2>T1</h2>")
    out, notes = page(f"<p>{IMG.format('a.png')}</p><h2>T1")
    assert not +notes


def test_flags():
    plain_ = overlay.Template({}, {}, {}, colour=False, dividers=False)
    text = '<body><hr><h2 style="color: blue">Introduction</h2></body>'
    out, notes = page(text, "Introduction and Objectives.html", plain_)
    assert "<hr>" in out and 'style="color: blue; padding: 10px;"' in out and notes[overlay.DIVIDERS] == 0
    out, notes = page(text, "Introduction and Objectives.html")
    assert "<hr>" not in out and "blue" not in out and notes[overlay.DIVIDERS] == 1
    for other in ("<body><p>x</p><hr><h2>Introduction</h2>", "<body><hr><p></p><h2>Introduction</h2>", "<hr><h2>Introduction</h2>", "<body><hr>"):
        assert page(other, "Introduction and Objectives.html")[1][overlay.DIVIDERS] == 0


def test_linear_time():
    start = time.process_time()
    for part in (f"<p>{IMG.format('a.png')}</p>", f"<div>{IMG.format('a.png')}</div><div>", "<h2>", "<p></p>", "<b>", f"<p>{IMG.format('a.png')}</p></div></div><p>&nbsp;</p>", "<h4>TemplateAssets/"):
        page("<body>" + part * (200_000 // len(part)), "learning activities.html")
    assert time.process_time() - start < 30


def test_glossary_feeds_a_template(spark):
    html = '<h2><img src="a/icons/Star.png"> Opening and/or start</h2><h3><img src="icons/star.png"></h3><h3><img src="/icons/book.png"> : Read </h3>'
    pages = spark.createDataFrame([("b-template-image-customizations.html", html), ("a-template-image-customizations.HTML", '<h1><b>First</b><img src="x/icons/book.png"></h1>'), ("c.html", html.replace("Opening", "Other")), (None, html), ("d-template-image-customizations.html", None)], "path string, html string")
    aliases = spark.createDataFrame([("Old.png", 1, "STAR.png"), ("Old.png", 0, "no.png"), ("book.png", 0, "star.png"), ("x.png", 0, "no.png")], "source string, pos int, target string")
    got = rules.glossary(pages, aliases)
    want = {"star.png": "Opening", "book.png": "First", "old.png": "Opening"} | rules.DEFAULT_LABELS
    assert {r["name"]: r["label"] for r in got.collect()} == want
    assert overlay.load_template(spark.createDataFrame([("a.png",)], "name string"), aliases, got).labels == want
    assert {r["name"]: r["label"] for r in rules.glossary(pages.limit(0), aliases.limit(0)).collect()} == rules.DEFAULT_LABELS

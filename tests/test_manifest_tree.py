import xml.etree.ElementTree as ET

from packloom.operators import manifest
from packloom.operators import manifest_tree as tree

XML = """<?xml version="1.0"?><manifest xmlns="http://www.imsglobal.org/xsd/imscp_v1p1" xmlns:x="u:x" identifier="M"><!-- gone --><metadata><x:a b="1"> t </x:a>tail</metadata>
<organizations><organization>
<item identifier="m1"><title>Module 1: Cells</title>
 <item identifier="auto_module_1_activities_header"><title>Activities</title></item>
 <item identifier="q" identifierref="rq"><title>Quiz | one</title></item>
 <item identifier="i" identifierref="ri"><title>Introduction and Objectives</title><item><title>Assignment | deep</title></item></item><metadata/></item>
<item identifier="s"><title>Course Overview</title><item identifier="a"><title>x</title></item><item identifier="h"><title>Student Resources</title></item></item>
<item identifier="n"><title>Module 2: Kept</title></item><item identifier="m3"><title>Module 3: Same</title><item identifier="o3"><title>Activities</title></item><item identifier="b3" identifierref="r"><title>thing</title></item></item>
</organization></organizations><resources><resource identifier="ri" href="a&amp;b.html"/></resources></manifest>"""


def shape(xml):
    def walk(e):
        return (e.tag, sorted(e.attrib.items()), (e.text or "").strip(), (e.tail or "").strip(), [walk(c) for c in e])

    return walk(ET.fromstring(xml))


def test_round_trip_loses_nothing(spark):
    df = spark.createDataFrame([(1, XML), (None, "<a>x<b/>y<!-- c -->z</a>"), (2, "<broken"), (3, None), (4, "")], "package int, content string")
    got = {r.package: r.content for r in tree.write_manifests(tree.parse_nodes(df)).collect()}
    assert set(got) == {1, None} and shape(got[1]) == shape(XML) and shape(got[None]) == shape("<a>x<b/>yz</a>")
    assert 'xmlns:x="u:x"' in got[1] and 'xmlns="http://www.imsglobal.org/xsd/imscp_v1p1"' in got[1]
    again = spark.createDataFrame(list(got.items()), "package int, content string")
    rows = lambda d: sorted(map(str, tree.parse_nodes(d).drop("prefixes").collect()))
    assert rows(again) == rows(df)


def test_restructured_manifest_reads_as_the_structure(spark):
    df = spark.createDataFrame([("p", XML), ("q", XML.replace("Cells", "Other"))], "package string, content string")
    items = manifest.parse_manifests(df)
    out = tree.write_manifests(tree.restructured(tree.parse_nodes(df), items)).collect()
    assert len(out) == 2
    root = ET.fromstring(next(r.content for r in out if r.package == "p"))
    ns = "{http://www.imsglobal.org/xsd/imscp_v1p1}"
    org = root.find(f"{ns}organizations/{ns}organization")

    def titles(e):
        return [(i.get("identifier"), i.findtext(f"{ns}title")) for i in e.findall(f"{ns}item")]

    modules = {m.get("identifier"): m for m in org.findall(f"{ns}item")}
    assert titles(org) == [("m1", "Module 1: Cells"), ("s", "Start Here"), ("n", "Module 2: Kept"), ("m3", "Module 3: Same")]
    # The old header's name is taken while headers are named.
    assert titles(modules["m1"]) == [("auto_module_1_overview_header", "Overview"), ("i", "Module 1: Introduction and Checklist"), ("auto_module_1_activities_header", "Activities"), ("q", "Quiz: one")]
    assert [c.tag for c in modules["m1"]][:2] == [f"{ns}title", f"{ns}metadata"]
    assert titles(modules["s"]) == [("a", "x"), ("auto_module_0_canvas_support_resources_header", "Canvas Support Resources"), ("h", "Student Resources")]
    # Nothing changes here: the old header stays.
    assert titles(modules["m3"]) == [("o3", "Activities"), ("b3", "thing")]
    assert titles(modules["m1"].find(f"{ns}item[@identifier='i']")) == [(None, "Assignment: deep")]
    # What was written has the structure that the operator gives.
    back = manifest.restructure(manifest.parse_manifests(spark.createDataFrame([(r.package, r.content) for r in out], "package string, content string")))
    view = lambda d: sorted((r.package, r.module, r.position, r.is_header, r.title) for r in d.where("module LIKE 'Module%'").collect())
    assert view(back) == view(manifest.restructure(items))


def test_empty(spark):
    df = spark.createDataFrame([], "package string, content string")
    assert tree.write_manifests(tree.restructured(tree.parse_nodes(df), manifest.parse_manifests(df))).count() == 0

"""Manifests as flat item tables: parsing, titles, structure, joins to files."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.html import compare_key
from packloom.runtime import prepare

ITEMS = "item_id string, parent_id string, depth int, ordinal int, title string, identifierref string, description string"
#: What a title's first part starts with where bars become colons.
DELIMITER_HINTS = [
    "assignment", "discussion", "lesson", "quiz", "exam", "survey", "syllabus", "course overview", "course requirements",
    "grading information", "guidelines", "preparing your course", "review", "announcement", "instructor guide", "start here",
]
#: Titles of shell modules, and what they are called beside a template.
START_HERE, INSTRUCTOR = "Start Here", "Instructor Module (Do Not Publish)"
CARRYOVER = {START_HERE: "D2L Start Here Carryover (Manual Placement)", INSTRUCTOR: "D2L Instructor Carryover (Manual Placement)"}
SUPPORT_HEADER, ABOUT_HEADER = "Canvas Support Resources", "About This Template"
GROUPS = ["Overview", "Activities", "Review"]


def parse_manifests(df: DataFrame, key: str = "package", xml: str = "content") -> DataFrame:
    """Items of each manifest, namespaces dropped, in document order. A broken
    manifest gives no items."""
    kind = dict(df.dtypes)[key]
    names = [key, *(c.split()[0] for c in ITEMS.split(", "))]

    def local(tag):
        return tag.rpartition("}")[2]

    def walk(node, parent, depth, out, counter):
        for child in node:
            if local(child.tag) == "item":
                title = next((c.text or "" for c in child if local(c.tag) == "title"), "")
                counter[0] += 1
                item = child.get("identifier") or f"item-{counter[0]}"
                out.append((item, parent, depth, counter[0], title.strip(), child.get("identifierref"), child.get("description") or ""))
                walk(child, item, depth + 1, out, counter)
            elif local(child.tag) in ("manifest", "organizations", "organization"):
                walk(child, parent, depth, out, counter)

    def run(batches):
        for b in batches:
            rows = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out: list = []
                try:
                    walk(ET.fromstring(x), None, 0, out, [0]) if x else None
                except ET.ParseError:
                    out = []
                rows += [(k, *r) for r in out]
            c = list(zip(*rows)) or [()] * len(names)
            types = [b.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(c, types)], names=names)

    prepare(df.sparkSession)
    return df.select(key, xml).mapInArrow(run, f"`{key}` {kind}, {ITEMS}")


def normal_delimiters(title: Column) -> Column:
    """"Quiz | Name" to "Quiz: Name" and "Quiz: 2 | a | b" to "Quiz 2: a b", where the
    first part starts with a known word; other titles stay as they are."""
    value = F.regexp_replace(F.trim(title), r"(?U)\s+", " ")
    parts = F.filter(F.transform(F.split(value, r"\|"), lambda p: F.regexp_replace(p, r"^[ :|-]+|[ :|-]+$", "")), lambda p: p != "")
    first = F.get(parts, F.lit(0))
    numbered = r"^([A-Za-z ]+):\s*(\d+)\s*$"
    first = F.when(first.rlike(numbered), F.concat_ws(" ", F.trim(F.regexp_extract(first, numbered, 1)), F.regexp_extract(first, numbered, 2))).otherwise(first)
    key = compare_key(first, "")
    known = F.coalesce(*(F.when(F.startswith(key, F.lit(h)), True) for h in DELIMITER_HINTS), F.lit(False))
    rebuilt = F.concat(first, F.lit(": "), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(2))), " "))
    return F.when(F.contains(value, F.lit("|")) & (F.size(parts) > 1) & known, rebuilt).otherwise(title)


def topic_to_module(title: Column) -> Column:
    """"Topic 07 | x", "Topic7 - x" and "topic 7: x" to "Module 7: x"."""
    return F.regexp_replace(title, r"(?is)^\s*topic\s*0*(\d+)\s*[|:-]\s*(.+?)\s*$", "Module $1: $2")


def module_number(title: Column) -> Column:
    """The number of "Module 3: x", else null."""
    p = r"(?i)^\s*Module\s*0*(\d+)\s*:\s*(.+?)\s*$"
    return F.when(title.rlike(p), F.regexp_extract(title, p, 1).cast("long"))


def child_kind(title: Column) -> Column:
    """What a numbered module's child is, by its title."""
    k = compare_key(title, "")
    holds = lambda *ws: F.coalesce(*(F.when(F.contains(k, F.lit(w)), True) for w in ws), F.lit(False))
    return (
        F.when(k.isin("overview", "activities", "review"), F.concat(F.lit("subheader_"), k))
        .when(holds("introduction and objectives", "introduction and checklist") | F.startswith(k, F.lit("introduction")), "overview_intro")
        .when(holds("learning activities"), "overview_learning")
        .when(holds("lesson"), "overview_lesson")
        .when(F.endswith(k, F.lit(" review")), "review_page")
        .otherwise("activity")
    )


def child_title(title: Column, number: Column, kind: Column) -> Column:
    """The title of a numbered module's child in the template's wording."""
    key = compare_key(title, "")
    n = F.concat(F.lit("Module "), number.cast("string"), F.lit(": "))
    holds = lambda *ws: F.coalesce(*(F.when(F.contains(key, F.lit(w)), True) for w in ws), F.lit(False))

    def tail(prefix: str, empty: str) -> Column:
        t = F.regexp_replace(F.trim(F.regexp_replace(title, rf"(?i)^\s*{prefix}\s*(?:\||:|-)?\s*", "")), r"^[-:| ]+|[-:| ]+$", "")
        return F.when(t == "", empty).otherwise(t)

    return (
        F.when(kind == "overview_intro", F.concat(n, F.lit("Introduction and Checklist")))
        .when(kind == "overview_learning", F.concat(n, F.lit("Learning Activities")))
        .when(kind == "overview_lesson", F.concat(n, F.lit("Lesson "), tail(r"lesson(?:\s*page)?", "[Title]")))
        .when(kind == "review_page", F.concat(n, F.lit("Review")))
        .when(holds("discussion"), F.concat(n, F.lit("Discussion "), tail("discussion", "[Title Here]")))
        .when(holds("assignment"), F.concat(n, F.lit("Assignment "), tail("assignment", "[Title Here]")))
        .when(holds("quiz", "test", "survey", "exam"), F.concat(F.lit("Quiz: "), tail("(?:quiz|test|survey|exam)", "[Title Here]")))
        .otherwise(title)
    )


def top_title(title: Column, beside_template: bool = False) -> Column:
    """The title of a shell module; other titles stay."""
    name = lambda t: F.lit(CARRYOVER[t] if beside_template else t)
    k = compare_key(title, "")
    instructor = F.startswith(k, F.lit("faculty resources")) | F.contains(k, F.lit("hidden from students")) | (k == "instructor module do not publish")
    return F.when(instructor, name(INSTRUCTOR)).when(F.startswith(k, F.lit("course overview")) | (k == "start here"), name(START_HERE)).otherwise(title)


def restructure(items: DataFrame, key: str = "package", beside_template: bool = False) -> DataFrame:
    """Modules and their children in the template's order and wording.

    ``items`` are those of :func:`parse_manifests`. Children of modules "Module n: x"
    are retitled and come in the groups overview, activities, review, each after a
    header; old headers go, unless the module has nothing else. "Start Here" gets a
    header before its first resources for students, the instructor module one before
    all, if they have none. Returns DataFrame[key, parent_id, module, position,
    is_header, item_id, title]; titles below the first level lose their bars.
    """
    tops = items.where("depth = 0").select(key, F.col("item_id").alias("parent_id"), top_title(F.col("title"), beside_template).alias("module"))
    kids = items.where("depth = 1").select(key, "parent_id", "ordinal", "item_id", normal_delimiters(F.col("title")).alias("title")).join(tops, [key, "parent_id"])
    number = module_number(F.col("module"))
    kind = child_kind(F.col("title"))
    title = F.when(number.isNull() | F.startswith(kind, F.lit("subheader_")), F.col("title")).otherwise(child_title(F.col("title"), number, kind))
    kids = kids.withColumn("number", number).withColumn("old", F.startswith(kind, F.lit("subheader_"))).withColumn("title", title)
    kind = child_kind(F.col("title"))
    group = F.when(F.col("number").isNull() | F.col("old"), F.lit(-1)).when(kind.isin("overview_intro", "overview_learning", "overview_lesson"), 0).when(kind == "review_page", 2).otherwise(1)
    k = compare_key(F.col("title"), "")
    help_ = F.contains(k, F.lit("resource")) & (F.contains(k, F.lit("student")) | F.contains(k, F.lit("support")) | F.contains(k, F.lit("canvas")))
    w = Window.partitionBy(key, "parent_id")
    kids = kids.withColumn("g", group).withColumn("more", F.max(~F.col("old")).over(w)).where(F.col("number").isNull() | ~F.col("old") | ~F.col("more"))
    # One row for each module and group: where a header goes, if it gets one.
    heads = kids.groupBy(key, "parent_id", "module", "number", "g").agg(
        F.min("ordinal").alias("first"),
        F.min(F.when(help_, F.col("ordinal"))).alias("help"),
        F.max(k == compare_key(F.lit(SUPPORT_HEADER), "")).alias("has_support"),
        F.max(k == compare_key(F.lit(ABOUT_HEADER), "")).alias("has_about"),
    )
    head = (
        F.when(F.col("number").isNotNull() & (F.col("g") >= 0), F.element_at(F.array(*map(F.lit, GROUPS)), F.col("g") + 1))
        .when((F.col("module") == START_HERE) & ~F.col("has_support") & (F.col("help") > F.col("first")), SUPPORT_HEADER)
        .when((F.col("module") == INSTRUCTOR) & ~F.col("has_about"), ABOUT_HEADER)
    )
    at = F.when(F.col("module") == START_HERE, F.col("help")).otherwise(F.col("first"))
    heads = heads.withColumn("title", F.when((F.col("g") < 0) & F.col("number").isNotNull(), F.lit(None)).otherwise(head)).where("title is not null")
    heads = heads.select(key, "parent_id", "module", "g", at.alias("ordinal"), F.lit(0).alias("h"), F.lit(None).cast("string").alias("item_id"), "title")
    both = kids.select(key, "parent_id", "module", "g", "ordinal", F.lit(1).alias("h"), "item_id", "title").unionByName(heads)
    # A group's header leads it; a header among other children stands before its child.
    order = [F.col("g"), F.when(F.col("g") >= 0, F.col("h")).otherwise(0), "ordinal", "h"]
    return both.withColumn("position", F.row_number().over(w.orderBy(*order))).select(key, "parent_id", "module", "position", (F.col("h") == 0).alias("is_header"), "item_id", "title")


def children(items: DataFrame, key: str = "package") -> DataFrame:
    """DataFrame[key, parent_id, titles]: the titles of each module's children, in
    order; a module's children are as many as its manifest has."""
    kids = items.where("depth = 1").groupBy(key, "parent_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "title"))).alias("x"))
    return kids.select(key, "parent_id", F.transform("x", lambda c: c["title"]).alias("titles"))


def outline(items: DataFrame, key: str = "package") -> DataFrame:
    """DataFrame[key, level, title, ordinal]: titles of the first level (top), of the
    second (section) and of all items (all). A single first item without a title is
    unwrapped: its children are the first level."""
    root = items.where("depth = 0").groupBy(key).agg((F.count("*") == 1).alias("one"), F.max(F.col("title") == "").alias("bare"))
    j = items.join(root, key).withColumn("d", F.col("depth") - F.when(F.col("one") & F.col("bare"), 1).otherwise(0)).where("d >= 0 and title <> ''")
    level = F.when(F.col("d") == 0, F.array(F.lit("top"), F.lit("all"))).when(F.col("d") == 1, F.array(F.lit("section"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    return j.select(key, F.explode(level).alias("level"), "title", "ordinal")


def items_with_files(items: DataFrame, resources: DataFrame, documents: DataFrame, key: str = "package") -> DataFrame:
    """Items joined to their resource's file, by two equality joins."""
    r = resources.select(key, F.col("identifier").alias("identifierref"), F.col("href").alias("path"))
    return items.join(r, [key, "identifierref"], "left").join(documents, [key, "path"], "left")

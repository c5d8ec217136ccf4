"""Labels, icons and assets of a template that pages are moved to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.html import basename, compare_key, decode_basic, let, plain_text

#: Fixed values. Labels of headings, the first rule that holds decides: icon, keys of
#: the label, and the label in the template's wording. Rules of the first table need the
#: icon and one of the keys, those of the second the icon or one of the keys.
LABELS_FIRST = [
    ("video.png", ["view", "watch"], "View"),
]
BOOKMARK_LABELS = [("syllabus", "Syllabus"), ("title", "Title"), ("bookmark", "Title")]
LABELS = [
    ("", ["objectives", "learning objectives", "module objectives"], "Module Objectives"),
    ("", ["course materials and outcomes", "course material and outcomes", "course material"], "Course Materials and Outcomes"),
    ("checklist.png", ["checklist"], "Checklist"),
    ("checkmark.png", ["module checklist"], "Module Checklist"),
    ("star.png", ["introduction"], "Introduction"),
    ("folder.png", ["additional resources", "explore resources", "resources", "supplemental resource", "supplemental resources"], "Additional Resources"),
    ("circle-arrow.png", ["practice", "practice games", "practice and review", "review", "flashcards"], "Practice"),
    ("exclamation.png", ["important", "important note", "important information"], "Important"),
    ("info.png", ["information", "info"], "Information"),
    ("calendar.png", ["calendar", "due date", "due dates"], "Due Dates"),
    ("educator.png", ["instructor information", "about the instructor", "contact information"], "Instructor Information"),
    ("gear.png", ["technical support", "support", "canvas support"], "Technical Support"),
    ("", ["main point"], "Main Point"),
    ("", ["student support"], "Student Support"),
    ("flag.png", ["guidelines", "guideline"], "Guidelines"),
    ("mail.png", ["communication", "course communication"], "Communication"),
    ("question.png", ["hints", "help links", "help"], "Help Links"),
    ("megaphone.png", ["announcement", "announcements"], "Announcement"),
    ("reminder.png", ["reminder", "reminders"], "Reminder"),
    ("book.png", ["read", "read this"], "Read"),
    ("headphones.png", ["listen", "hear this", "listen to this"], "Listen"),
    ("download.png", ["download", "download this"], "Download"),
    ("paper.png", ["do this"], "Do This"),
    ("pencil.png", ["assignment", "instructions"], "Instructions"),
    ("ai-brain.png", ["ai usage allowed", "ai usage", "artificial intelligence"], "AI Usage Allowed"),
]
#: Icons by phrases of label and title, the first rule that holds decides.
ICONS = [
    (["practice", "review", "practice games", "flashcards", "publisher materials"], "circle-arrow.png"),
    (["resource", "resources", "explore resources", "additional resources", "supplemental resource", "supplemental resources", "sample forms", "forms", "files", "documents", "materials"], "folder.png"),
    (["quiz", "assessment", "knowledge check", "self check", "check your understanding"], "rocket.png"),
    (["read", "reading", "article", "chapter", "textbook"], "book.png"),
    (["technical support", "canvas support", "help desk", "helpdesk", "tech support"], "gear.png"),
    (["instructor information", "about the instructor", "contact information", "office hours"], "educator.png"),
    (["communication", "communicate", "course q and a", "course q a", "question board"], "mail.png"),
    (["main point", "guidelines", "classroom community", "student support"], "flag.png"),
    (["calendar", "due date", "due dates", "course summary"], "calendar.png"),
    (["announcement", "announcements"], "megaphone.png"),
    (["instructions", "assignment directions", "assignment instructions"], "pencil.png"),
    (["ai usage", "artificial intelligence"], "ai-brain.png"),
    (["watch", "video", "lecture", "clip", "recording", "youtube", "vimeo", "ted talk"], "video.png"),
]
VIEW_ICONS, VIEW_KEYS, VIEW_ICON = ["bookmark.png", "video.png", "view.png"], ["view", "watch"], "bookmark.png"
REPLACED_ICONS = [("rocket.png", "folder.png"), ("reminder.png", "circle-arrow.png")]


def icon_name(path: Column) -> Column:
    """The name of an image's file in lower case."""
    return F.lower(F.trim(basename(F.replace(path, F.lit("\\"), F.lit("/")))))


def icon_label(raw: Column) -> Column:
    """A label without what follows "or", "and/or" or "also represents"."""
    t = F.regexp_replace(F.trim(decode_basic(raw)), r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"(?i)\s+(?:or|and/or)\s+.*$", "")
    t = F.regexp_replace(t, r"(?i)\s+also represents.*$", "")
    return F.regexp_replace(t, r"^[ :;,.-]+|[ :;,.-]+$", "")


#: Labels of icons that no page of the template explains.
DEFAULT_LABELS = {"checklist.png": "Checklist", "exclamation.png": "Important", "info.png": "Information"}
GLOSSARY_PAGE = "template-image-customizations"
_ICON_IN_HEADING = r"""(?i)<img\b[^>]*/icons/([^/"'>\s]+\.(?:png|jpg|jpeg|svg|gif|webp))[^>]*>"""


def glossary(pages: DataFrame, aliases: DataFrame, order: str = "path", path: str = "path", text: str = "html") -> DataFrame:
    """DataFrame[name, label] of a template's icons.

    A heading with an icon on a page that explains images gives the icon the rest of the
    heading as its label; the first page by ``order`` and the first heading in it win.
    Icons that are not explained have default labels. A name that only an alias
    (source, pos, target) knows has the label of the first of its targets that has one.
    Headings and labels are read natively; what is shuffled is one row an icon and page.
    """
    explaining = pages.where(F.lower(path).like("%.html") & F.contains(F.lower(path), F.lit(GLOSSARY_PAGE)))
    heads = explaining.select(F.col(order).alias("o"), F.posexplode(F.regexp_extract_all(text, F.lit(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>"), F.lit(1))).alias("at", "body"))
    label = icon_label(plain_text(F.regexp_replace("body", r"(?i)<img\b[^>]*>", "")))
    told = heads.select("o", "at", icon_name(F.regexp_extract("body", _ICON_IN_HEADING, 1)).alias("name"), label.alias("label")).where("name <> '' AND label <> ''")
    own = told.groupBy("name").agg(F.min_by("label", F.struct("o", "at")).alias("label"))
    default = pages.sparkSession.createDataFrame(list(DEFAULT_LABELS.items()), "name string, label string")
    known = own.unionAll(default.join(own, "name", "left_anti"))
    by = aliases.select(F.lower("source").alias("source"), "pos", F.lower("target").alias("name")).join(known, "name")
    more = by.groupBy("source").agg(F.min_by("label", "pos").alias("label")).select(F.col("source").alias("name"), "label")
    return known.unionAll(more.join(known, "name", "left_anti"))


def heading_key(text: Column) -> Column:
    return compare_key(plain_text(text), "")


def heading_label(raw: Column, icon: Column) -> Column:
    """A heading's label in the template's wording, by its icon or its own words."""
    def ladder(x: Column) -> Column:
        name, key = x["icon"], x["key"]
        rules = [F.when((name == i) | key.isin(keys), new) for i, keys, new in LABELS_FIRST]
        rules += [F.when((name == VIEW_ICON) & (key == k), new) for k, new in BOOKMARK_LABELS]
        rules += [F.when((name == i) | key.isin(keys) if i else key.isin(keys), new) for i, keys, new in LABELS]
        return F.coalesce(*rules, x.label)

    name = icon_name(F.coalesce(icon, F.lit("")))
    return let(icon_label(raw), lambda label: let(F.struct(label.alias("label"), name.alias("icon"), heading_key(label).alias("key")), ladder))


def semantic_icon(current: Column, label: Column, title: Column) -> Column:
    """The icon that a label and a title call for; the current one where none does."""

    def ladder(x: Column) -> Column:
        rules = [F.when(x.key.rlike("|".join(phrases)), new) for phrases, new in ICONS]  # phrases are plain words
        rules += [F.when(x.current.isin(VIEW_ICONS) | x.own.isin(VIEW_KEYS), VIEW_ICON)]
        rules += [F.when(x.current == old, new) for old, new in REPLACED_ICONS]
        return F.coalesce(*rules, x.current)

    told = F.trim(F.concat_ws(" ", F.when(label != "", label), F.when(title != "", title)))
    own = heading_key(F.coalesce(label, F.lit("")))
    return F.when(told == "", current).otherwise(let(F.struct(current.alias("current"), heading_key(told).alias("key"), own.alias("own")), ladder))


def new_assets(assets: DataFrame, members: DataFrame, folder: str = "TemplateAssets") -> DataFrame:
    """DataFrame[name, source, target, outcome] of a template's assets (name, path):
    copied where the name is unique and the package (path) has no such file yet, else
    collision or existing."""
    g = assets.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("source"))
    g = g.withColumn("target", F.concat(F.lit(folder + "/"), "name"))
    have = members.select(F.col("path").alias("target"), F.lit(True).alias("there")).distinct()
    j = g.join(have, "target", "left")
    return j.select("name", "source", "target", F.when(F.col("n") > 1, "collision").when(F.col("there"), "existing").otherwise("copied").alias("outcome"))


def content_targets(items: DataFrame, course: str, kind: str) -> DataFrame:
    """DataFrame[title, key, url] of a course's items (id, title, html_url); an item
    without address gets that of its id. Items without title or address go."""
    title = F.trim(F.coalesce("title", F.lit("")))
    own, number = F.trim(F.coalesce("html_url", F.lit(""))), F.trim(F.coalesce(F.col("id").cast("string"), F.lit("")))
    url = F.when(own != "", own).when(number != "", F.concat(F.lit(f"/courses/{course}/{kind}/"), number))
    return items.select(title.alias("title"), compare_key(title).alias("key"), url.alias("url")).where("title <> '' and url is not null")


def titles_or_names(pages: DataFrame, title: Column, path: str = "path") -> DataFrame:
    """Pages with ``title``: their own, else the stem of their file's name."""
    stem = F.regexp_replace(basename(F.col(path)), r"(?<=.)\.[^.]*$", "")
    return pages.withColumn("title", F.coalesce(F.when(title != "", title), stem))


#: The rule between a page and what is appended to it.
APPEND_RULE = '\n<hr style="border: 0; height: 2px; background-color: #ac1a2f; width: 100%; margin: 16px 0;">\n'


def append_fragment(page: Column, fragment: Column) -> Column:
    """A page with a fragment after a rule, before its first </body> or at its end."""
    more = F.concat(F.lit(APPEND_RULE), F.regexp_replace(fragment, r"(?U)^\s+|\s+$", ""), F.lit("\n"))
    at = F.regexp_instr(page, F.lit("(?i)</body>"))
    inside = F.concat(F.substring(page, F.lit(1), at - 1), more, F.lit("</body>"), F.substring(page, at + 7, F.length(page)))
    return F.when(at > 0, inside).otherwise(F.concat(F.regexp_replace(page, r"(?U)\s+$", ""), F.lit("\n"), more))


#: Titles of the pages that take a module's description, & as "and".
INTRO_TITLES = ["introduction and objectives", "intro and objectives"]
TOPIC_TITLE = r"(?is)^\s*topic\s*0*(\d+)\s*[|:-]\s*(.+?)\s*$"


def move_descriptions(items: DataFrame, resources: DataFrame, documents: DataFrame, wording, key: str = "package") -> DataFrame:
    """Descriptions of modules "Topic n | x" into their introduction pages:
    DataFrame[key, item_id, path, html, moved], a row for each that has such a page.

    ``items`` are those of a manifest, ``resources`` (identifier, href), ``documents``
    (path, html). A description needs a tag and is reworded by ``wording``; where the
    page has its text already nothing is appended (``moved`` false).
    """
    module = items.where("depth = 0").where(F.col("title").rlike(TOPIC_TITLE)).withColumn("d", F.trim("description")).where(F.contains("d", F.lit("<")))
    module = module.select(key, F.col("item_id").alias("module_id"), wording(F.col("d")).alias("d"))
    kids = items.where("depth = 1").where(compare_key(F.col("title"), "").isin(INTRO_TITLES))
    intro = kids.groupBy(key, F.col("parent_id").alias("module_id")).agg(F.min_by("identifierref", "ordinal").alias("identifier"))
    r = resources.groupBy(key, "identifier").agg(F.first("href").alias("path"))
    j = module.join(intro, [key, "module_id"]).join(r, [key, "identifier"]).join(documents, [key, "path"])
    text = lambda c: compare_key(plain_text(c), "")
    there = (text(F.col("d")) != "") & F.contains(text(F.col("html")), text(F.col("d")))
    return j.select(key, F.col("module_id").alias("item_id"), "path", F.when(there, F.col("html")).otherwise(append_fragment(F.col("html"), F.col("d"))).alias("html"), (~there).alias("moved"))


def is_syllabus(path: Column, title: Column, heading: Column) -> Column:
    """Whether a page is a syllabus, by path, title and first heading."""
    told = F.lower(F.concat_ws(" ", F.replace(path, F.lit("\\"), F.lit("/")), title, heading))
    return ~F.contains(told, F.lit("syllabus quiz")) & (F.contains(told, F.lit("syllabus")) | F.contains(told, F.lit("class meeting schedule")))

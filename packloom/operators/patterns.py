"""Patterns across packages: features, changes that recur, kept elements, icons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.arrow import title_case
from packloom.functions.html import basename, compare_key, count_of, headings, matches, plain_text, title_text

#: Pattern of each count of a package's pages.
PAGE_COUNTS = {
    "shared_template_refs": r"(?i)/shared/brightspace_html_template/",
    "template_asset_refs": r"(?i)templateassets/",
    "details_blocks": r"(?i)<details\b",
    "bootstrap_accordion_blocks": r"""(?i)<div\b[^>]*class\s*=\s*["'][^"']*\bcard-header\b""",
    "divider_count": r"(?i)<hr\b",
    "standard_dividers": r"(?i)<hr\b[^>]*height: 2px",
    "floated_images": r"""(?i)<img\b[^>]*(?:float\s*:|align\s*=\s*["']?(?:left|right))""",
    "safe_block_images": r"(?i)<img\b[^>]*display\s*:\s*block",
    "headings": r"(?i)<h[1-6]\b",
    "links": r"(?i)<a\b",
    "list_items": r"(?i)<li\b",
}


def package_html_features(pages: DataFrame, package: str = "package", text: str = "html") -> DataFrame:
    """One row per package: sums of counts over its pages, and pages by title."""
    t = F.col(text)
    title = F.lower(title_text(t))
    has = lambda s: F.count(F.when(F.contains(F.col("__t"), F.lit(s)), 1))
    rows = pages.select(package, title.alias("__t"), *(count_of(t, p).alias(k) for k, p in PAGE_COUNTS.items()))
    g = rows.groupBy(package).agg(F.count("*").alias("page_count"), has("introduction and objectives").alias("intro_objectives_titles"), has("introduction and checklist").alias("intro_checklist_titles"), *(F.sum(k).alias(k) for k in PAGE_COUNTS))
    return g.withColumn("nonstandard_dividers", F.col("divider_count") - F.col("standard_dividers"))


def transforms() -> list[tuple[str, Column, Column]]:
    """Key, where it can apply and where it did, over columns b_* and a_*."""
    b, a = (lambda k: F.col(f"b_{k}")), (lambda k: F.col(f"a_{k}"))
    return [
        ("intro_objectives_to_checklist", b("intro_objectives_titles") > 0, a("intro_checklist_titles") > 0),
        ("shared_template_to_local_assets", b("shared_template_refs") > 0, (a("shared_template_refs") == 0) & (a("template_asset_refs") > 0)),
        ("accordion_modernization", b("bootstrap_accordion_blocks") > 0, a("bootstrap_accordion_blocks") == 0),
        ("image_cleanup", b("floated_images") > 0, a("floated_images") < b("floated_images")),
        ("divider_normalization", a("divider_count") > 0, a("nonstandard_dividers") == 0),
    ]


def consensus_transforms(before: DataFrame, after: DataFrame, package: str = "package", more: list[tuple[str, Column, Column]] | None = None) -> DataFrame:
    """DataFrame[key, applicable, matching, rate, is_consensus] over packages that
    are in both tables: kept by two or more, and by half of those it applies to."""
    pre = lambda df, p: df.select(package, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != package))
    j = pre(before, "b").join(pre(after, "a"), package)
    rules = transforms() + (more or [])
    rows = j.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), ok.alias("applicable"), (ok & did).alias("matching")) for k, ok, did in rules))).alias("x")).select("x.*")
    g = rows.where("applicable").groupBy("key").agg(F.count("*").alias("applicable"), F.count(F.when(F.col("matching"), 1)).alias("matching"))
    rate = F.round(F.col("matching") / F.col("applicable"), 3)
    return g.withColumn("rate", rate).withColumn("is_consensus", (F.col("applicable") >= 2) & (F.col("matching") >= 2) & (F.col("rate") >= 0.5))


def kept_elements(elements: DataFrame, template: DataFrame, least: int = 2) -> DataFrame:
    """Template elements (kind, name) that at least ``least`` packages still have."""
    have = elements.select("package", "kind", compare_key(F.col("name")).alias("key")).join(template.select("kind", compare_key(F.col("name")).alias("key")).distinct(), ["kind", "key"])
    return have.groupBy("kind", "key").agg(F.countDistinct("package").alias("packages")).where(F.col("packages") >= least)


def icon_signatures(pages: DataFrame, package: str = "package", text: str = "html") -> DataFrame:
    """DataFrame[package, heading, icon]: headings that hold an image, first of
    each heading text."""
    heads = matches(F.col(text), r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>")
    rows = pages.select(package, F.posexplode(heads).alias("pos", "h"))
    icon = F.lower(basename(F.regexp_extract("h", r"""(?i)<img\b[^>]*\bsrc\s*=\s*["']([^"'?#]+)""", 1)))
    rows = rows.select(package, "pos", compare_key(plain_text(F.col("h"))).alias("heading"), icon.alias("icon")).where("icon <> '' and heading <> ''")
    return rows.groupBy(package, "heading").agg(F.min_by("icon", "pos").alias("icon"))


def icon_pairs(before: DataFrame, after: DataFrame, package: str = "package", least: int = 2) -> DataFrame:
    """Icons that became another one under the same heading in several packages."""
    j = before.withColumnRenamed("icon", "before").join(after.withColumnRenamed("icon", "after"), [package, "heading"])
    return j.groupBy("before", "after").agg(F.countDistinct(package).alias("packages"), F.min("heading").alias("sample")).where(F.col("packages") >= least)


def delimiter_stats(titles: DataFrame, package: str = "package", title: str = "title") -> DataFrame:
    t = F.col(title)
    n = lambda c: F.count(F.when(c, 1))
    return titles.groupBy(package).agg(F.count("*").alias("titles"), n(t.rlike(r"\s\|\s")).alias("with_pipe"), n(t.rlike(r"^[^:|]+:\s")).alias("with_colon"))


def overlay_totals(refs: DataFrame) -> DataFrame:
    """Totals of resolved template references (path, name, asset, outcome)."""
    n = lambda *o: F.count(F.when(F.col("outcome").isin(*o), 1))
    bad = F.col("outcome").isin("collision", "unmapped")
    return refs.agg(F.countDistinct("path").alias("files_scanned"), F.countDistinct(F.when(bad, F.col("path"))).alias("files_with_unresolved"), n("direct").alias("mapped_direct"), n("alias").alias("mapped_alias"), n("direct", "alias").alias("mapped_total"), n("collision", "unmapped").alias("unresolved_total"))


def module_wording(text: Column) -> Column:
    """Topic wording of introduction pages as module wording."""
    #: Patterns and what they become, in order.
    steps = [
        (r"(?i)\btopic\s*0*(\d+)\s*(?:\||-|:)\s*", "Module $1: "),
        (r"(?i)\bthis topic\b", "this module"),
        (r"(?i)\bthe topic\b", "the module"),
        (r"(?i)after completing the learning activities for this module,\s*you will be able to\s*:", "By the end of this module, you will be able to:"),
        (r"(?i)to meet the learning objectives for this module,\s*you will complete(?: these| the following)? activities\s*:", "In order to successfully complete this module, please do the following:"),
        (r"(?i)\bintroduction and objectives\b", "Introduction and Checklist"),
    ]
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


#: Folders of modules, and titles of pages by the instructor.
MODULE_FOLDER = r"(?s)^(\d{2})-(.+?)/"
WELCOME_TITLES = ["welcome from instructor", "welcome from the instructor", "text from"]


def page_role(path: Column, title: Column) -> Column:
    """module_intro, welcome_instructor or standalone."""
    p, t = F.lower(path), F.lower(F.trim(title))
    intro = path.rlike(MODULE_FOLDER) & p.rlike("introduction|objectives")
    welcome = t.rlike("|".join(WELCOME_TITLES)) | (F.contains(p, F.lit("welcome")) & F.contains(p, F.lit("instructor")))
    return F.when(intro, "module_intro").when(welcome, "welcome_instructor").otherwise("standalone")


def page_roles(pages: DataFrame, path: str, title: Column) -> DataFrame:
    """Pages with ``role`` and, of introductions, module_number and chapter_title."""
    own = lambda x: F.when(F.col("role") == "module_intro", x)
    chapter = F.translate(F.regexp_extract(path, MODULE_FOLDER, 2), "_-", "  ")
    rows = pages.withColumn("role", page_role(F.col(path), title))
    return rows.withColumn("module_number", own(F.regexp_extract(path, MODULE_FOLDER, 1).try_cast("int"))).withColumn("chapter_title", F.coalesce(own(F.trim(title_case(chapter))), F.lit("")))


def outline(text: Column, limit: int = 8) -> Column:
    """The first headings with text."""
    return F.slice(F.filter(headings(text), lambda h: (h != "") & (F.lower(h) != "printer-friendly version")), 1, limit)


#: Shell modules that a template protects.
PROTECTED_SHELLS = ["Start Here", "Instructor Module (Do Not Publish)"]


def protected_shells(children: DataFrame, template: DataFrame, packages: int, least: int = 2, limit: int = 12) -> tuple[DataFrame, DataFrame]:
    """Shell modules of packages against those of the template.

    ``children`` (package, shell, title) of ``packages`` packages, ``template`` (shell,
    title). Returns DataFrame[title, training_course_presence, template_child_count,
    recommended_protected_shell], and DataFrame[shell, kind, title, course_count] of
    children that recur: those of the template, and the ``limit`` most common others.
    A child counts once for each time that a package has it.
    """
    shells = children.sparkSession.createDataFrame([(t,) for t in PROTECTED_SHELLS], "title string")
    own = template.withColumn("key", compare_key(F.col("title"))).where("key <> ''").groupBy("shell", "key").agg(F.max("title").alias("name"))
    seen = children.groupBy("shell").agg(F.countDistinct("package").alias("presence"))
    n = template.groupBy("shell").agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = shells.join(seen, shells["title"] == seen["shell"], "left").drop("shell").join(n, shells["title"] == n["shell"], "left")
    rows = rows.select("title", zero("presence").alias("training_course_presence"), zero("n").alias("template_child_count"), (zero("presence") >= max(2, packages // 2)).alias("recommended_protected_shell"))
    kids = children.where(F.col("shell").isin(PROTECTED_SHELLS)).withColumn("key", compare_key(F.col("title"))).where("key <> ''").join(own, ["shell", "key"], "left")
    kind = F.when(F.col("name").isNull(), "custom").otherwise("intact")
    g = kids.groupBy("shell", kind.alias("kind"), F.coalesce("name", "title").alias("title")).agg(F.count("*").alias("course_count"))
    w = Window.partitionBy("shell", "kind").orderBy(F.desc("course_count"), "title")
    g = g.withColumn("r", F.row_number().over(w)).where((F.col("kind") == "intact") | (F.col("r") <= limit))
    return rows, g.where(F.col("course_count") >= least).drop("r")


def current_alignment(current: DataFrame, kept: DataFrame, limit: int = 10) -> DataFrame:
    """DataFrame[kind, name, rank]: template elements kept by other packages, ``kept``
    (kind, name, packages), that the current one, ``current`` (kind, name), has too; the
    first ``limit`` of each kind."""
    by = lambda df, n: df.withColumn(n, F.when(F.col("kind") == "asset", F.lower("name")).otherwise(compare_key(F.col("name"))))
    have = by(current, "key").select("kind", "key").where("key <> ''").distinct()
    w = Window.partitionBy("kind").orderBy(F.desc("packages"), "name")
    return by(kept, "key").join(have, ["kind", "key"], "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("kind", "name", "rank")


def file_date(name: Column) -> Column:
    """The first date 20yymmdd of a file's name without its extension, or 0."""
    stem = F.regexp_replace(basename(name), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.regexp_extract(stem, r"(20\d{6})", 1).try_cast("int"), F.lit(0))


def latest_template(files: DataFrame, group: list[str], path: str = "path") -> DataFrame:
    """Of each group the template export with the latest date in its name; the larger
    name, letter case aside, wins ties."""
    name = basename(F.col(path))
    found = files.where(name.rlike(r"(?s)^elearn-standard-template-export.*\.imscc$"))
    return found.groupBy(*group).agg(F.max_by(path, F.struct(file_date(F.col(path)), F.lower(name))).alias("template"))


def manifest_hrefs(xml: Column) -> Column:
    """Values of double-quoted href attributes, without parsing."""
    return matches(xml, r'(?i)href\s*=\s*"([^"]+)"', 1)


def files_outside_manifest(members: DataFrame, manifests: DataFrame, package: str = "package") -> DataFrame:
    """Members (package, path) that their package's manifest (package, xml) names
    nowhere."""
    hrefs = manifests.select(package, F.explode(manifest_hrefs(F.col("xml"))).alias("path")).distinct()
    return members.where("path <> 'imsmanifest.xml'").join(hrefs, [package, "path"], "left_anti")


def course_code(explicit: Column, paths: list[Column], snapshot_code: Column) -> Column:
    """A course's code: the given one, else the folder of the first file that is not in
    output or resources, else that of the snapshot, else a constant."""
    folders = [F.trim(F.regexp_extract(p, r"([^/]+)/[^/]*$", 1)) for p in paths]
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(F.when(explicit != "", F.trim(explicit)), *(F.when((f != "") & ~F.lower(f).isin("output", "resources"), f) for f in folders), some(snapshot_code), F.lit("current-course"))

"""Local images of pages as data URIs, and catalogues of a package's icons and banners.

References are resolved to members by equality joins, first by name, then by name in
lower case. What an image weighs is known before it is sent: images beyond a bound, and
those beyond a page's budget, stay references and are counted, so a page's text grows by
no more than the budget. A page gets an image once, however often it refers to it. All of
it is built-in expressions.
"""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.arrow import normal_path
from packloom.functions.html import basename

#: Bytes of an image that is embedded, and of all those of a page, at most.
IMAGE_BYTES, PAGE_BYTES = 2 << 20, 16 << 20
# The attribute, what is no local reference, icons and their labels.
SRC = r"""(?i)\bsrc\s*=\s*(["'])[^"']+\1"""
SRC_HEAD = r"""(?is)^(src\s*=\s*["']).*$"""
NOT_LOCAL = r"(?:#|data:|mailto:|tel:|javascript:|//|[A-Za-z][A-Za-z0-9+.-]*:)"
ICONS = [
    ("star.png", "Introduction"), ("bullseye.png", "Module Objectives"), ("checkmark.png", "Module Checklist"), ("calendar.png", "Due Dates"),
    ("book.png", "Read"), ("headphones.png", "Listen"), ("video.png", "View"), ("bookmark.png", "View This"), ("folder.png", "Additional Resources"),
    ("circle-arrow.png", "Practice"), ("rocket.png", "Assessment"), ("pencil.png", "Instructions"), ("paper.png", "Do This"),
    ("exclamation.png", "Important"), ("info.png", "Information"), ("reminder.png", "Reminder"), ("flag.png", "Guidelines"),
    ("megaphone.png", "Announcement"), ("mail.png", "Communication"), ("question.png", "Help Links"), ("educator.png", "Instructor Information"),
    ("gear.png", "Technical Support"), ("download.png", "Download"), ("ai-brain.png", "AI Usage Allowed"),
]
ICON_FOLDER = "templateassets/"


def image_type(path: Column) -> Column:
    """The MIME type of an image by its name, else null."""
    known = {e[1:]: t for e, t in mimetypes.types_map.items() if t.startswith("image/")} | {"svgz": "image/svg+xml"}
    table = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair))
    return F.element_at(table, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)))


def data_uri(content: Column, kind: Column) -> Column:
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def asset_name(page: Column, ref: Column) -> Column:
    """The member that a reference of a page means, in normal form; null where it is not
    local."""
    bare = F.replace(F.regexp_replace(F.trim(ref), r"[?#].*$", ""), F.lit("\\"), F.lit("/"))
    folder = F.regexp_extract(page, r"^(.*/)", 1)
    full = F.when(F.startswith(bare, F.lit("/")), F.regexp_replace(bare, "^/+", "")).otherwise(F.concat(folder, bare))
    return F.when((bare != "") & ~F.trim(ref).rlike(f"^{NOT_LOCAL}"), normal_path(full))


def resolved(pages: DataFrame, members: DataFrame, package: str = "package") -> DataFrame:
    """DataFrame[package, path, ref, asset, size] of the references of pages (package,
    path, html) to images among the members (package, path, size)."""
    refs = pages.select(package, "path", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(SRC), F.lit(0)), lambda m: F.trim(F.regexp_replace(m, r"""(?is)^src\s*=\s*["'](.*)["']$""", "$1"))))).alias("ref")).where("ref <> ''")
    named = refs.withColumn("name", asset_name(F.col("path"), F.col("ref"))).where(image_type(F.col("name")).isNotNull())
    images = members.where(image_type(F.col("path")).isNotNull()).select(package, F.col("path").alias("asset"), "size")
    exact = images.groupBy(package, F.col("asset").alias("name")).agg(F.max("size").alias("size"), F.max("asset").alias("asset"))
    folded = images.groupBy(package, F.lower("asset").alias("lower")).agg(F.max_by(F.struct("asset", "size"), "asset").alias("other"))
    j = named.join(exact, [package, "name"], "left").withColumn("lower", F.lower("name")).join(folded, [package, "lower"], "left")
    return j.select(package, "path", "ref", F.coalesce("asset", "other.asset").alias("asset"), F.when(F.col("asset").isNotNull(), F.col("size")).otherwise(F.col("other.size")).alias("size")).where("asset IS NOT NULL")


def embed(pages: DataFrame, members: DataFrame, package: str = "package", image_bytes: int = IMAGE_BYTES, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """DataFrame[package, path, html, embedded, too_large, over_budget]: pages (package,
    path, html) with the local images among the members (package, path, content) in them,
    and how many references were embedded, are to too large an image, or came when the
    page's budget was spent (by reference, in order). A null page stays null."""
    sized = members.where("content IS NOT NULL").select(package, "path", F.octet_length("content").cast("long").alias("size"))
    found = resolved(pages, sized, package)
    # What one image weighs in a page it weighs once.
    first = Window.partitionBy(package, "path", "asset").orderBy("ref")
    spent = Window.partitionBy(package, "path").orderBy("asset", "ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.when((F.col("size") <= image_bytes) & (F.row_number().over(first) == 1), F.col("size")).otherwise(0)
    dealt = found.withColumn("weight", weight).withColumn("sum", F.sum("weight").over(spent))
    dealt = dealt.withColumn("fate", F.when(F.col("size") > image_bytes, "too_large").when(F.col("sum") > page_bytes, "over_budget").otherwise("embedded"))
    # A hot image meets its pages in a join that adaptive execution can split.
    uri = members.where(image_type(F.col("path")).isNotNull() & (F.octet_length("content") <= image_bytes)).groupBy(package, F.col("path").alias("asset")).agg(F.max("content").alias("content")).select(package, "asset", data_uri(F.col("content"), image_type(F.col("asset"))).alias("uri"))
    used = dealt.where("fate = 'embedded'").select(package, "path", "ref", "asset").join(uri, [package, "asset"])
    maps = used.groupBy(package, "path").agg(F.map_from_entries(F.collect_list(F.struct("ref", "uri"))).alias("uris"))
    count = dealt.groupBy(package, "path").agg(*(F.sum((F.col("fate") == f).cast("long")).alias(f) for f in ("embedded", "too_large", "over_budget")))
    j = pages.select(package, "path", "html").join(maps, [package, "path"], "left").join(count, [package, "path"], "left")
    return j.select(package, "path", with_sources(F.col("html"), F.col("uris")).alias("html"), *(F.coalesce(f, F.lit(0)).alias(f) for f in ("embedded", "too_large", "over_budget")))


def with_sources(html: Column, by_ref: Column) -> Column:
    """A page whose ``src`` attributes have what a map gives for them."""
    tags = F.regexp_extract_all(html, F.lit(SRC), F.lit(0))
    head = lambda m: F.regexp_replace(m, SRC_HEAD, "$1")

    def put(m: Column) -> Column:
        new = F.element_at(by_ref, F.trim(F.regexp_replace(m, r"""(?is)^src\s*=\s*["'](.*)["']$""", "$1")))
        return F.when(new.isNotNull(), F.concat(head(m), new, F.right(m, F.lit(1)))).otherwise(m)

    # The pieces between the attributes are one more than these.
    pieces = F.split(html, SRC, -1)
    joined = F.array_join(F.zip_with(pieces, F.transform(tags, put), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(by_ref.isNull(), html).otherwise(joined)


def icon_catalogue(members: DataFrame, packages: DataFrame, package: str = "package") -> DataFrame:
    """DataFrame[package, position, name, label, data_uri] of the template's icons in each
    package; the address is empty where a package has no such file."""
    own = members.where(F.startswith(F.lower("path"), F.lit(ICON_FOLDER))).groupBy(package, F.lower("path").alias("at")).agg(F.min_by("content", "path").alias("content"))
    every = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), F.lit(x).alias("label")) for i, (n, x) in enumerate(ICONS)))
    rows = packages.select(package).distinct().select(package, F.explode(every).alias("x")).select(package, "x.*", F.concat(F.lit(ICON_FOLDER), "x.name").alias("at"))
    uri = F.when(F.col("content").isNotNull(), data_uri(F.col("content"), image_type(F.col("name")))).otherwise("")
    return rows.join(own, [package, "at"], "left").select(package, "position", "name", "label", uri.alias("data_uri"))


def banner_catalogue(members: DataFrame, package: str = "package") -> DataFrame:
    """DataFrame[package, name, raw_ref, label, data_uri] of a package's banners; of files
    with one name the last path counts."""
    lower = F.lower("path")
    rows = members.where(F.contains(lower, F.lit("banner")) & lower.rlike(r"\.(?:png|jpe?g)$"))
    g = rows.groupBy(package, basename(F.col("path")).alias("name")).agg(F.max_by("content", "path").alias("content"))
    words = F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), r"[-_\s]+", " ")), " "), lambda w: (w != "") & (F.lower(w) != "banner"))
    label = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1_000)))), " ")
    return g.select(package, "name", F.concat(F.lit("../TemplateAssets/"), "name").alias("raw_ref"), F.when(label == "", F.col("name")).otherwise(label).alias("label"), data_uri(F.col("content"), image_type(F.col("name"))).alias("data_uri"))

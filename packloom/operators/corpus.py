"""Corpora of packages: artifacts, snapshots, structure and reference classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.html import held_parts, is_local, references
from packloom.operators.resolve import resolve_paths

TOPIC_PART, MODULE_PART = r"(?i)^topic\s*\d+", r"(?i)^module\s*\d+"


def course_token(code: Column) -> Column:
    return F.regexp_replace(F.lower(code), "[^a-z0-9]+", "")


def number_tokens(text: Column) -> Column:
    """Numbers of 4 or 5 digits in a text, longer ones cut."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d{4,5}"), F.lit(0)))


def snapshot_index(files: DataFrame) -> DataFrame:
    """DataFrame[snapshot, keys, numbers] of snapshots (path, content as JSON text): the
    tokens of the folder, the course's code and name and its id, and the numbers in them.
    Where a text is no JSON object the folder alone counts."""
    at = lambda p: F.coalesce(F.get_json_object("content", p), F.lit(""))
    folder = F.regexp_extract(F.replace("path", F.lit("\\"), F.lit("/")), "([^/]*)/[^/]*$", 1)
    told = F.array(folder, at("$.course.course_code"), at("$.course.name"), at("$.course_id"))
    keys = F.array_distinct(F.filter(F.transform(told, course_token), lambda k: k != ""))
    return files.select(F.col("path").alias("snapshot"), keys.alias("keys"), F.array_distinct(F.flatten(F.transform(told, number_tokens))).alias("numbers"))


def match_snapshots(courses: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Courses (course) to snapshots, those of ``snapshot_index`` (snapshot, keys, numbers)
    or with one key each (snapshot, name): an equal token, else a key that holds the
    course's token, else the one snapshot that shares a number of 4 or 5 digits. Of several
    snapshots the first by name counts. Adds ``snapshot`` and ``how``.

    ``pos`` in the snapshots, where there is one, is their place in the listing: then the
    first by place counts, and names only decide where places are equal.

    Nothing meets in pairs: a key stands for all snapshots that have it, the containment arm
    joins by equal parts of keys, and a number tells only its first and last snapshot (all
    are one where these are one).
    """
    c = courses.select("course", course_token(F.col("course")).alias("token"), number_tokens(F.col("course")).alias("nums")).where("token <> ''").distinct()
    place = F.col("pos").cast("long") if "pos" in snapshots.columns else F.lit(0).cast("long")
    who = F.struct(place.alias("pos"), "snapshot").alias("who")
    if "keys" in snapshots.columns:
        every = snapshots.select(who, "keys", F.col("numbers").alias("snums"))
    else:
        every = snapshots.select(who, F.array(course_token(F.col("name"))).alias("keys"), number_tokens(F.col("name")).alias("snums"))
    s = every.select("who", F.explode("keys").alias("key")).groupBy("key").agg(F.min("who").alias("who"))
    exact = c.join(s.hint("merge"), c["token"] == s["key"]).groupBy("course").agg(F.min("who.snapshot").alias("exact"))
    open_ = c.join(exact.hint("merge"), "course", "left_anti").select("course", "token")
    parts = held_parts(s, "key", open_.select("token").distinct(), "token").groupBy(F.col("part").alias("token")).agg(F.min("who").alias("who"))
    inside = open_.join(parts.hint("merge"), "token").groupBy("course").agg(F.min("who.snapshot").alias("inside"))
    told = every.select("who.snapshot", F.explode("snums").alias("num")).groupBy("num").agg(F.min("snapshot").alias("a"), F.max("snapshot").alias("z"))
    shared = c.select("course", F.explode("nums").alias("num")).join(told.hint("merge"), "num")
    only = shared.groupBy("course").agg(F.min("a").alias("only"), F.max("z").alias("last")).where("only = last").drop("last")
    j = courses.join(exact, "course", "left").join(inside, "course", "left").join(only, "course", "left")
    how = F.when(F.col("exact").isNotNull(), "token").when(F.col("inside").isNotNull(), "contains").when(F.col("only").isNotNull(), "number")
    return j.select(*courses.columns, F.coalesce("exact", "inside", "only").alias("snapshot"), how.alias("how"))


def reference_classes(pages: DataFrame, members: DataFrame) -> DataFrame:
    """Counts of references of each package (package, path, html) by class, with
    the package's (package, path) members as what they can resolve to."""
    rows = pages.select("package", "path", F.explode(references(F.col("html"))).alias("url")).withColumn("url", F.trim("url"))
    kind = F.when(F.col("url").rlike(r"(?i)^/?(?:d2l/|content/enforced/)"), "legacy").when(F.col("url").rlike(r"(?i)^/?shared/brightspace_html_template/"), "shared_template").when(F.col("url").rlike("(?i)^https?://"), "external").when(is_local(F.col("url")), "local")
    rows = rows.withColumn("kind", kind).where("kind is not null")
    # The package name leads every path, so one cascade serves all packages.
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    clean = F.regexp_replace(F.regexp_replace("url", r"[#?].*$", ""), r"^[./]+", "")
    refs = rows.where("kind = 'local'").select("package", F.concat_ws("/", F.col("package").cast("string"), F.concat(folder, clean)).alias("ref"), F.concat_ws("/", F.col("package").cast("string"), F.regexp_replace(folder, "/$", "")).alias("page_dir"))
    got = resolve_paths(refs, members.select(F.concat_ws("/", F.col("package").cast("string"), "path").alias("path")).distinct())
    done = got.select("package", F.when(F.col("arm") == "missing", "unresolved").when(F.col("arm").isin("exact", "casefold"), F.col("arm")).otherwise("basename").alias("kind"))
    return done.unionByName(rows.where("kind <> 'local'").select("package", "kind")).groupBy("package", "kind").agg(F.count("*").alias("n"))


def corpus_totals(classes: DataFrame) -> DataFrame:
    return classes.groupBy("kind").agg(F.sum("n").alias("n"), F.countDistinct("package").alias("packages"))


def structure_summary(members: DataFrame) -> DataFrame:
    """HTML files below topic and module folders, of each package."""
    parts = F.split("path", "/")
    n = lambda p: F.count(F.when(F.exists(parts, lambda x: x.rlike(p)), 1))
    return members.where(F.col("path").rlike(r"(?i)\.html?$")).groupBy("package").agg(n(TOPIC_PART).alias("topic_html_files"), n(MODULE_PART).alias("module_html_files"), F.count("*").alias("html_files"))


def template_inventory(members: DataFrame) -> DataFrame:
    """Assets, icons, banners, buttons and wiki pages of a template package."""
    p = F.lower("path")
    n = lambda rx: F.count(F.when(p.rlike(rx), 1))
    return members.groupBy("package").agg(n(r"\.(png|jpe?g|gif|svg|css|js)$").alias("assets"), n(r"icon[^/]*\.(png|svg)$").alias("icons"), n(r"banner[^/]*$").alias("banners"), n(r"button[^/]*$").alias("buttons"), n(r"wiki_content/.*\.html?$").alias("wiki_pages"))


def best_artifacts(files: DataFrame) -> DataFrame:
    """Per course, the root with most kinds of artifacts (earlier roots win ties),
    and in it the latest file of each kind. Rows: (course, root, kind, path, ts)."""
    score = files.groupBy("course", "root").agg(F.countDistinct("kind").alias("kinds"))
    root = score.groupBy("course").agg(F.max_by("root", F.struct(F.col("kinds"), (-F.col("root")).alias("r"))).alias("root"))
    w = Window.partitionBy("course", "kind").orderBy(F.desc("ts"), "path")
    return files.join(root, ["course", "root"]).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def recent_distinct(entries: DataFrame, order: str, value: str, limit: int = 25) -> DataFrame:
    """The latest ``limit`` different values, letter case aside: a bounded history."""
    g = entries.groupBy(F.lower(value).alias("key")).agg(F.max_by(value, order).alias("value"), F.max(order).alias("last"))
    return g.orderBy(F.desc("last"), "key").limit(limit).select("value", "last")

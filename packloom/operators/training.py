"""Files of training courses: what each is, pairs of packages, profiles, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.html import fold
from packloom.operators.corpus import course_token

#: Kinds of files by path below a course's folder, the first that a course
#: has decides; of the files of one pattern the latest counts. Folders that are no courses.
KINDS = [
    ("before_zip", [r"^before/d2l-export\.zip$", r"^before/[^/]*\.zip$", r"^[^/]*\.zip$"]),
    ("after_zip", [r"^after/canvas-gold-export\.imscc$", r"^after/[^/]*\.imscc$", r"^[^/]*\.imscc$"]),
    ("snapshot_json", [r"^after/canvas-snapshot\.json$", r"^after/[^/]*\.snapshot\.json$"]),
    ("snapshot_markdown", [r"^after/canvas-snapshot\.md$", r"^after/[^/]*\.snapshot\.md$"]),
    ("issues_json", [r"^baseline/canvas-migration-issues\.json$", r"^canvas-migration-issues\.json$"]),
    ("metadata_json", [r"^metadata\.json$"]),
]
NEEDED = ["before_zip", "after_zip", "snapshot_json", "issues_json"]
SKIPPED = ["template"]
#: Descriptions of two import issues that are counted apart.
QUIZ_KEY = "The importer couldn't determine the correct answers for this question."
MISSING_PAGE_LINK = "Missing links found in imported content - Wiki Page body"
NEGATIVE = ["do not", "don't", "avoid", "never", "remove", "disable"]


def discover(files: DataFrame) -> DataFrame:
    """One row for each course: DataFrame[course, root, <kinds>, completeness_score].

    ``files`` has (root, course, path, mtime): the number of a root folder, the course's
    folder in it, a path below that, and when it was written. Courses that have no
    package, snapshot or issues go, as do folders with a leading underscore; a course
    that several roots have is taken from the one with most kinds, the first of equals.
    """
    kind = [F.when(F.col("path").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(-i).alias("rank"))) for k, ps in KINDS for i, p in enumerate(ps)]
    known = files.where(~F.startswith("course", F.lit("_")) & ~F.lower("course").isin(SKIPPED))
    rows = known.select("root", "course", "path", "mtime", F.explode(F.array_compact(F.array(*kind))).alias("x"))
    best = rows.groupBy("root", "course", "x.kind").agg(F.max_by("path", F.struct("x.rank", "mtime", "path")).alias("path"))
    wide = best.groupBy("root", "course").agg(*(F.max(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k, _ in KINDS))
    score = sum((F.when(F.col(k).isNotNull(), 1).otherwise(0) for k, _ in KINDS[1:]), F.when(F.col(KINDS[0][0]).isNotNull(), 1).otherwise(0))
    wide = wide.withColumn("completeness_score", score).where(F.coalesce(*NEEDED).isNotNull())
    chosen = wide.groupBy("course").agg(F.max_by(F.struct(*wide.columns), F.struct("completeness_score", -F.col("root"))).alias("x"))
    return chosen.select("x.course", "x.root", *(f"x.{k}" for k, _ in KINDS), "x.completeness_score")


def training_pairs(artifacts: DataFrame, features: DataFrame, package: str = "package") -> DataFrame:
    """Courses with both packages, and the features of each as before and after."""
    f = F.struct(*(c for c in features.columns if c != package))
    side = lambda n: features.select(F.col(package).alias(f"{n}_zip"), f.alias(n))
    pairs = artifacts.where("before_zip is not null and after_zip is not null").select("course", "root", "before_zip", "after_zip")
    return pairs.join(side("before"), "before_zip").join(side("after"), "after_zip").select("course", "root", "before_zip", "after_zip", "before", "after")


def training_profiles(profiles: DataFrame, current: str, course: str = "course") -> DataFrame:
    """Profiles of courses with a snapshot (has_snapshot) other than the current one,
    whose code is compared without case and punctuation."""
    return profiles.where("has_snapshot").where(course_token(F.col(course)) != course_token(F.lit(current)))


def issue_totals(issues: DataFrame, course: str = "course") -> DataFrame:
    """Import issues (course, phase, description) of each course, before and after the
    import: all, and those on page links and quiz keys."""
    d, p = F.col("description"), F.col("phase")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return issues.groupBy(course).agg(
        n(p == "pre", "pre_import_issue_total"),
        n((p == "pre") & (d == MISSING_PAGE_LINK), "pre_import_missing_page_links"),
        n(p == "post", "post_import_issue_total"),
        n((p == "post") & (d == MISSING_PAGE_LINK), "post_import_missing_page_links"),
        n((p == "post") & (d == QUIZ_KEY), "post_import_quiz_key_warnings"),
    )


def negative_statement(text: Column) -> Column:
    """Whether advice says what not to do."""
    low = fold(text)
    return F.coalesce(*(F.when(F.contains(low, F.lit(m)), True) for m in NEGATIVE), F.lit(False))


def unresolved_sample(refs: DataFrame, limit: int = 40, package: str = "package") -> DataFrame:
    """The first ``limit`` unresolved references (path, pos, ref) of each package, by
    page and place. Each task keeps that many of a package at most before they meet."""
    first = refs.groupBy(package, "path").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "ref"))), 1, limit).alias("x"))
    # Pages that may have one of the first: those before which fewer stand.
    before = F.sum(F.size("x")).over(Window.partitionBy(package).orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    kept = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < limit)
    rows = kept.select(package, "path", "before", F.posexplode("x").alias("i", "r")).where(F.col("before") + F.col("i") < limit)
    return rows.select(package, (F.col("before") + F.col("i") + 1).alias("rank"), "path", F.col("r.ref").alias("ref"))


def page_updates(pages: DataFrame, course: str) -> DataFrame:
    """What is to be written to a course: DataFrame[course, slug, title, body, action],
    update of pages that it has (slug not null), else create under a slug of the title."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return pages.select(F.lit(course).alias("course"), F.coalesce("slug", slug).alias("slug"), "title", F.col("html").alias("body"), F.when(F.col("slug").isNull(), "create").otherwise("update").alias("action"))


def pages_by_name(members: DataFrame, key: str | None = None, package: str = "package") -> DataFrame:
    """HTML members (package, path, html) of templates by name, the last of a name; or
    the first by path whose path holds ``key``."""
    pages = members.where(F.endswith(F.lower("path"), F.lit(".html")))
    if key is not None:
        return pages.where(F.contains(F.lower("path"), F.lit(key))).groupBy(package).agg(F.min_by("html", "path").alias("html"), F.min("path").alias("path"))
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    return pages.groupBy(package, name.alias("name")).agg(F.max_by("html", "path").alias("html"))

"""Reports of packages as lines: the report of a conversion and the checklist before an
import, one of each for every package.

A report is rows (package, section, rank, key, at, line). All packages' reports are made by
the same few aggregations, and ``packloom.sources.texts`` writes them, a file a package, in
the order of the rows; no report is put together anywhere but in the file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of a report's lines.
ORDER = ["section", "rank", "key", "at"]
#: Reasons and files that a report of a conversion names.
SHOWN = 8

Line = str | Column


def _text(*parts: Line) -> Column:
    """A line of fixed text and columns; a null column is empty, a truth value is True or
    False."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _truth(c: str) -> Column:
    return F.initcap(F.coalesce(F.col(c), F.lit(False)).cast("string"))


def section(df: DataFrame, number: int, lines: list[Line | None], rank: Column | None = None, key: Column | None = None) -> DataFrame:
    """Lines of each row; a null line is left out. Rows come by rank, then key."""
    every = F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))
    rows = df.select("package", F.lit(number).alias("section"), (rank if rank is not None else F.lit(0)).cast("long").alias("rank"), (key if key is not None else F.lit("")).alias("key"), F.posexplode(every).alias("at", "line"))
    return rows.where("line IS NOT NULL")


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def issues_of(files: DataFrame) -> DataFrame:
    """DataFrame[package, path, type, pos, reason] of results (package, path, manual,
    accessibility arrays of reason and evidence); reasons without text go."""
    tag = lambda c, kind: F.transform(F.coalesce(c, F.array().cast("array<struct<reason:string,evidence:string>>")), lambda x: F.struct(F.lit(kind).alias("type"), F.trim(F.coalesce(x["reason"], F.lit(""))).alias("reason")))
    rows = files.select("package", "path", F.posexplode(F.concat(tag(F.col("manual"), "manual"), tag(F.col("accessibility"), "accessibility"))).alias("pos", "x"))
    return rows.select("package", "path", "x.type", "pos", "x.reason")


def _reasons(issues: DataFrame) -> DataFrame:
    """Reasons of each package and type by how often they occur, then by where they do
    first."""
    n = issues.where("reason <> ''").groupBy("package", "type", "reason").agg(F.count("*").alias("n"), F.min(F.struct("path", "pos")).alias("first"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("package", "type").orderBy(F.desc("n"), "first")))


def _affected(issues: DataFrame) -> DataFrame:
    count = lambda kind: F.count(F.when(F.col("type") == kind, 1))
    n = issues.groupBy("package", "path").agg(F.count("*").alias("total"), count("manual").alias("manual"), count("accessibility").alias("access"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("package").orderBy(F.desc("total"), F.desc("manual"), "path")))


def totals(files: DataFrame) -> DataFrame:
    """DataFrame[package, scanned, changed, changes, manual, access, manual_files,
    access_files] of results."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    changes = F.coalesce(F.aggregate("changes", F.lit(0).cast("long"), lambda a, c: a + c["count"]), F.lit(0))
    some = lambda c: F.count(F.when(size(c) > 0, 1))
    return files.groupBy("package").agg(
        F.count("*").alias("scanned"), F.count(F.when(F.col("changed"), 1)).alias("changed"), F.sum(changes).alias("changes"), F.sum(size("manual")).alias("manual"), F.sum(size("accessibility")).alias("access"),
        some("manual").alias("manual_files"), some("accessibility").alias("access_files"),
    )


def _with_totals(packages: DataFrame, files: DataFrame) -> DataFrame:
    t = packages.join(totals(files), "package", "left")
    return t.fillna(0, ["scanned", "changed", "changes", "manual", "access", "manual_files", "access_files"])


OVERLAY = ["template_package", "alias_map", "report", "asset_dir", "copied", "direct", "alias", "unresolved", "ignored"]
ALIGNMENT = ["source", "critical_ids", "action_ids", "placeholders", "closer_present"]


def conversion_reports(packages: DataFrame, files: DataFrame, overlay: DataFrame | None = None, alignment: DataFrame | None = None) -> DataFrame:
    """The report of each package's conversion.

    ``packages``: package, input, output, rules, profile, math, enforced, manifest.
    ``files``: package, path, changed, changes, manual, accessibility. ``overlay``: package
    and OVERLAY, for those moved to a template; ``alignment``: package and ALIGNMENT (arrays
    of ids, the number of placeholders), for those held against reference documents.
    """
    t = _with_totals(packages, files)
    issues = issues_of(files)
    reasons, worst = _reasons(issues).where(F.col("place") <= SHOWN), _affected(issues)
    code = lambda label, c, other="": _text(f"{label}: `", F.coalesce(F.when(c.cast("string") != "", c.cast("string")), F.lit(other)), "`")
    col = F.col
    parts = [
        section(t, 0, [
            "# LMS Migration Pilot Report", "", code("Input zip", col("input")), code("Output zip", col("output")), code("Rules", col("rules")), code("Policy profile", col("profile")),
            code("Math handling", col("math"), "preserve-semantic"), code("Best-practice enforcer enabled", _truth("enforced")), code("IMS manifest found", _truth("manifest")), "", "## Summary", "",
            _text("- HTML files scanned: ", col("scanned")), _text("- HTML files changed: ", col("changed")), _text("- Automated changes applied: ", col("changes")), _text("- Manual review issues: ", col("manual")), _text("- Accessibility issues: ", col("access")), "",
            "## Unresolved / Manual Items", "", _text("- Files with manual review issues: ", col("manual_files")), _text("- Files with accessibility issues: ", col("access_files")),
        ]),
        section(worst.where("place = 1"), 5, ["- Most-affected files:"]),
        section(worst.where(col("place") <= SHOWN), 6, [_text("  - `", col("path"), "` (manual: ", col("manual"), ", a11y: ", col("access"), ")")], col("place")),
        section(t, 7, [""]),
        section(t, 9, ["## Files With Issues", ""]),
        section(worst, 10, [_text("- `", col("path"), "`")], key=col("path")),
        section(t.where("manual_files = 0 AND access_files = 0"), 10, ["- None"]),
        section(t, 12, [""]),
    ]
    for kind, number, label in (("manual", 1, "manual review"), ("accessibility", 3, "accessibility")):
        own = reasons.where(col("type") == kind)
        parts += [section(own.where("place = 1"), number, [f"- Top {label} reasons:"]), section(own, number + 1, [_text("  - (", col("n"), ") ", col("reason"))], col("place"))]
    if overlay is not None:
        n = lambda label, c: _text(f"- {label}: ", F.coalesce(col(c), F.lit(0)))
        parts.append(section(overlay, 8, [
            "## Template Overlay", "", "- Enabled: `True`", code("- Template package", col("template_package")), code("- Alias map JSON", col("alias_map"), "none"), code("- Overlay report JSON", col("report"), "n/a"), code("- Materialized template assets dir", col("asset_dir"), "n/a"),
            n("Materialized assets copied", "copied"), n("Mapped (direct)", "direct"), n("Mapped (alias)", "alias"), n("Unresolved template refs", "unresolved"), n("Ignored unresolved framework refs", "ignored"), "",
        ]))
    if alignment is not None:
        listed = lambda label, c: F.when(F.size(F.filter(c, lambda x: x != "")) > 0, _text(f"- {label}: ", F.array_join(F.filter(c, lambda x: x != ""), ", ")))
        parts.append(section(alignment, 11, [
            "", "## Reference Alignment", "", code("- Source", col("source")), _text("- Critical instruction gaps: ", F.size("critical_ids")), _text("- Best-practice topics needing new rule/report coverage: ", F.size("action_ids")),
            _text("- Template placeholders detected in template docs: ", col("placeholders")), _text("- Module Checklist required closer present in template docs: ", F.initcap(F.coalesce(col("closer_present"), F.lit(True)).cast("string"))),
            listed("Critical gap IDs", "critical_ids"), listed("Coverage action IDs", "action_ids"),
        ]))
    return _all(*parts)


def preflight_checklists(packages: DataFrame, files: DataFrame, profiles: DataFrame, alignment: DataFrame | None = None) -> DataFrame:
    """What is to be checked of each package before its release.

    ``packages``: package, input, output, profile. ``profiles``: profile, description, items
    (array). ``alignment`` as for ``conversion_reports``.
    """
    t = _with_totals(packages, files).join(profiles, "profile", "left")
    reasons = _reasons(issues_of(files))
    col = F.col
    item = lambda *parts: _text("- [ ] ", *parts)
    none = F.array().cast("array<string>")
    own = t.select("package", F.posexplode(F.coalesce("items", none)).alias("place", "item"))
    parts = [
        section(t, 0, [
            "# Migration Preflight Checklist", "", _text("- Input zip: `", col("input"), "`"), _text("- Output zip: `", col("output"), "`"), _text("- Policy profile: `", col("profile"), "`"), _text("- Profile description: ", col("description")), "",
            "## Automated Summary", "", _text("- HTML files scanned: ", col("scanned")), _text("- HTML files changed: ", col("changed")), _text("- Manual review issues: ", col("manual")), _text("- Accessibility issues: ", col("access")), "",
            "## Required Verifications Before Release", "",
        ]),
        section(own, 1, [item(col("item"))], col("place")),
        section(t.where(F.size(F.coalesce("items", none)) == 0), 1, [item("Review manual findings and accessibility findings before release.")]),
        section(t, 2, ["", "## Findings-Based Follow-Up", ""]),
        section(t.select("package").join(reasons.select("package").distinct(), "package", "left_anti"), 3, [item("No issues flagged by automation."), ""]),
    ]
    for kind, number, label in (("manual", 3, "Manual Review"), ("accessibility", 6, "Accessibility")):
        some = reasons.where(col("type") == kind)
        first = some.where("place = 1")
        parts += [section(first, number, [f"### {label} Reasons", ""]), section(some, number + 1, [item("(", col("n"), ") ", col("reason"))], col("place")), section(first, number + 2, [""])]
    if alignment is not None:
        gaps, wanted = F.size("critical_ids"), F.size("action_ids")
        when = lambda c, *line: F.when(c, item(*line))
        parts.append(section(alignment, 9, [
            "## Reference Alignment Follow-Up", "",
            when(gaps > 0, "Resolve `", gaps, "` critical instruction gap(s) identified in reference audit."),
            when(wanted > 0, "Add migration rule/check coverage for `", wanted, "` best-practice topic(s)."),
            when(~F.coalesce(col("closer_present"), F.lit(True)), "Update template/rules to enforce Module Checklist closing reminder."),
            when(F.coalesce(col("placeholders"), F.lit(0)) > 0, "Verify unresolved template placeholders are cleaned up before release."),
            when((gaps == 0) & (wanted == 0), "Reference audit shows no unresolved governance gaps."), "",
        ]))
    return _all(*parts)


# Lines of the summaries of packages, by column.
SAFE = [("html_files_scanned", "scanned"), ("html_files_changed", "changed"), ("total_automated_changes", "changes"), ("manual_review_issues", "manual"), ("accessibility_issues", "access")]
VISUAL = [
    ("Files scanned", "files_scanned"), ("Files with duplicate title/first-block", "files_with_duplicate_title_first_block"), ("Files with shared template refs remaining", "files_with_remaining_shared_template_refs"),
    ("Files with <title> tags remaining", "files_with_remaining_title_tags"), ("Files with nonstandard horizontal dividers", "files_with_nonstandard_hr"), ("Files with icon sizing anomalies", "files_with_icon_size_anomalies"),
    ("Accordion cards in original", "total_original_accordion_cards"), ("Details blocks in converted", "total_converted_details_blocks"), ("MathML expressions in original", "total_original_mathml"),
    ("MathML expressions in converted", "total_converted_mathml"), ("WIRIS annotation nodes remaining in converted", "total_converted_wiris_annotations"),
]
SNAPSHOT = ["pages", "modules", "files", "assignments", "discussions", "announcements"]
CORPUS = [
    ("D2L html files", "html_file_count"), ("D2L local refs", "local_refs"), ("D2L legacy /d2l refs", "legacy_d2l_refs"), ("D2L shared template refs", "shared_template_refs"),
    ("D2L unresolved local refs (pre-fix)", "local_refs_unresolved"), ("Canvas issues total", "issues"), ("Canvas missing page links", "missing_page_links"), ("Canvas quiz-answer-key warnings", "quiz_key_warnings"),
]


def _number(label: str, c: str) -> Column:
    return _text(f"{label}: ", F.coalesce(F.col(c), F.lit(0)))


def safe_summaries(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Counts of each package (package, profile) and of its reasons, with no text of any
    page."""
    t = _with_totals(packages, files)
    reasons = _reasons(issues_of(files))
    profile = F.coalesce(F.when(F.col("profile") != "", F.col("profile")), F.lit("unknown"))
    parts = [section(t, 0, ["SUMMARY", _text("policy_profile: ", profile), *(_number(k, c) for k, c in SAFE), ""]), section(t, 6, [""])]
    for kind, number, label in (("manual", 1, "MANUAL_REVIEW"), ("accessibility", 4, "ACCESSIBILITY")):
        own = reasons.where(F.col("type") == kind)
        none = t.select("package").join(own.select("package").distinct(), "package", "left_anti")
        parts += [section(t, number, [f"{label}_REASON_COUNTS"]), section(own, number + 1, [_text(F.col("n"), " | ", F.col("reason"))], F.col("place")), section(none, number + 1, ["0 | none"])]
    parts.append(section(t, 3, [""]))
    return _all(*parts)


def visual_reports(summaries: DataFrame) -> DataFrame:
    """What the visual audit of each package counted (package and the columns of VISUAL)."""
    return section(summaries, 0, ["# Visual Audit", "", "## Summary", "", *(_number(f"- {label}", c) for label, c in VISUAL), ""])


def snapshot_reports(snapshots: DataFrame) -> DataFrame:
    """Snapshots of courses: package, generated, base_url, course_id, name, code, counts of
    SNAPSHOT, json and markdown (paths)."""
    code = lambda label, c: _text(f"- {label}: `", F.col(c), "`")
    return section(snapshots, 0, [
        "# Canvas Course Snapshot", "", _text("Generated: ", F.col("generated")), "", "## Course", "", code("Base URL", "base_url"), code("Course ID", "course_id"), code("Course Name", "name"), code("Course Code", "code"), "",
        "## Counts", "", *(_number(f"- {k.capitalize()}", k) for k in SNAPSHOT), "", "## Outputs", "", code("Snapshot JSON", "json"), code("Snapshot Markdown", "markdown"),
    ])


def practice_reports(tables: DataFrame, duplicates: DataFrame, conflicts: DataFrame, redundancies: DataFrame, shown: int = 25) -> DataFrame:
    """Audits of practice tables: ``tables`` (package, input, rows), groups of equal rows
    (package, group, row), sources with several pieces of advice (package, source, row) and
    near-equal rows (package, left_row, right_row, similarity as text), of which the first
    ``shown`` are told. Groups are told by their first row, rows of a group in order; a
    group's rows are one line."""

    def grouped(df: DataFrame, by: str) -> DataFrame:
        rows = df.groupBy("package", by).agg(F.min("row").alias("first"), F.concat_ws(", ", F.transform(F.sort_array(F.collect_list("row")), lambda r: r.cast("string"))).alias("rows"))
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("package").orderBy("first", by)))

    same, against = grouped(duplicates, "group"), grouped(conflicts, "source")
    near = redundancies.withColumn("place", F.row_number().over(Window.partitionBy("package").orderBy("left_row", "right_row")))
    n = lambda df: df.groupBy("package").agg(F.count("*").alias("n"))
    t = tables
    for name, df in (("same", same), ("against", against), ("near", near)):
        t = t.join(n(df).withColumnRenamed("n", name), "package", "left")
    parts = [section(t, 0, [
        "# Best Practices Audit Report", "", _text("Input: `", F.col("input"), "`"), _text("Rows evaluated: ", F.col("rows")), "", "## Findings", "",
        _number("- Exact duplicates", "same"), _number("- Potential conflicts", "against"), _number("- Potential redundancies", "near"), "",
    ])]
    line = F.col("place")
    for number, df, title, row in (
        (1, same, "## Duplicate Groups", _text("- Rows: ", F.col("rows"))),
        (4, against, "## Conflict Groups", _text("- Source key `", F.col("source"), "` in rows: ", F.col("rows"))),
        (7, near.where(F.col("place") <= shown), "## Redundancy Candidates", _text("- Rows ", F.col("left_row"), " and ", F.col("right_row"), " (similarity: ", F.col("similarity"), ")")),
    ):
        head = df.where("place = 1")
        parts += [section(head, number, [title, ""]), section(df, number + 1, [row], line), section(head, number + 2, [""])]
    return _all(*parts)


def corpus_reports(corpora: DataFrame, overall: DataFrame, courses: DataFrame, skipped: DataFrame) -> DataFrame:
    """Analyses of training corpora: ``corpora`` (package, generated, examples, snapshots),
    totals (package, key, value), courses (package, course, source, snapshot or null,
    snapshot_id, snapshot_code, the columns of CORPUS, pages, modules, files) and folders
    that were passed over (package, course, reason). Courses and folders come by name."""
    c = F.col
    there = c("snapshot").isNotNull()
    gold = F.when(there, _text("- Gold snapshot pages/modules/files: ", F.coalesce("pages", F.lit(0)), "/", F.coalesce("modules", F.lit(0)), "/", F.coalesce("files", F.lit(0)))).otherwise("- Gold snapshot pages/modules/files: n/a")
    head = skipped.select("package").distinct()
    return _all(
        section(corpora, 0, ["# Training Corpus Analysis", "", _text("Generated: ", c("generated")), "", _text("- Examples directory: `", c("examples"), "`"), _text("- Snapshot root: `", c("snapshots"), "`"), "", "## Overall", ""]),
        section(overall, 1, [_text("- ", c("key"), ": ", c("value"))], key=c("key")),
        section(corpora, 2, ["", "## Per Course", ""]),
        section(courses, 3, [
            _text("### ", c("course")), _text("- Source package: `", c("source"), "`"), F.when(there, _text("- Snapshot JSON: `", c("snapshot"), "`")).otherwise("- Snapshot JSON: `(not found)`"),
            F.when(there, _text("- Snapshot course: `", c("snapshot_id"), "` | `", c("snapshot_code"), "`")), *(_number(f"- {label}", k) for label, k in CORPUS), gold, "",
        ], key=c("course")),
        section(head, 4, ["## Skipped Folders", ""]),
        section(skipped, 5, [_text("- ", c("course"), ": ", c("reason"))], key=c("course")),
        section(head, 6, [""]),
    )

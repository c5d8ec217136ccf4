"""Reports in Markdown, as tables of lines.

A report is DataFrame[section, key, pos, line]: the lines of a section by ``key``, and of
one key by ``pos``. Nothing is gathered in one task; :func:`write_report` sorts the lines
by range when it writes them as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.operators.findings import priority_rank


def _section(df: DataFrame, number: int, key: Column | None, lines: list) -> DataFrame:
    """Lines (texts, or columns that may be null for none) of each row of ``df``."""
    text = F.array_compact(F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines)))
    rows = df.select((F.lit("") if key is None else key).alias("key"), F.posexplode(text).alias("pos", "line"))
    return rows.select(F.lit(number).alias("section"), "key", "pos", "line")


def _report(*sections: DataFrame) -> DataFrame:
    out = sections[0]
    for s in sections[1:]:
        out = out.unionAll(s)
    return out


def _line(label: str, c: Column | str) -> Column:
    return F.concat(F.lit(label), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _falling(n: Column) -> Column:
    """A key under which larger counts come first."""
    return F.lpad((F.lit(10**12) - n).cast("string"), 13, "0")


def write_report(report: DataFrame, path: str) -> None:
    report.orderBy("section", "key", "pos").select("line").write.text(path)


def checklist_report(items: DataFrame, inputs: dict[str, str | None]) -> DataFrame:
    """The checklist: inputs, counts by priority, source and category, and the items.
    ``inputs`` are names of files by label."""
    head = ["# Migration Fix Checklist", "", *(f"- {k}: `{v}`" if v else f"- {k}: none" for k, v in inputs.items())]
    order = F.concat_ws("|", priority_rank(F.col("priority")).cast("string"), "source", "category", "description")
    by = lambda c: items.groupBy(c).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    count = F.concat(F.lit(": "), F.col("n").cast("string"))
    item = F.concat(F.lit("- [ ] ("), "priority", F.lit(") ["), "source", F.lit("] "), "category", F.lit(" | "), "description", F.lit(" | owner: "), "owner", F.lit(" | count: "), F.col("count").cast("string"))
    one = items.agg(F.count("*").alias("n"))
    return _report(
        _section(one, 0, None, [*head, _line("- Total checklist items: ", "n"), "", "## Summary", ""]),
        _section(by("priority"), 1, priority_rank(F.col("priority")).cast("string"), [F.concat(F.lit("- "), "priority", count)]),
        _section(one, 2, None, [""]),
        _section(by("source"), 3, F.col("o"), [F.concat(F.lit("- "), "source", count)]),
        _section(one, 4, None, ["", "## Category Counts", ""]),
        _section(by("category"), 5, F.concat(_falling(F.col("n")), F.lit("|"), F.col("o")), [F.concat(F.lit("- "), "category", count)]),
        _section(one, 6, None, ["", "## Action Items", ""]),
        _section(items, 7, order, [item, F.concat(F.lit("  - Action: "), "action"), F.when(F.col("reference") != "", F.concat(F.lit("  - Reference: "), "reference"))]),
    )


#: Lines of the math audit, by total.
MATH_LINES = [
    ("Files scanned", "files_scanned"), ("Files with math", "files_with_math"), ("Files with math review flags", "files_with_math_review_flags"), ("Files with mixed math modes", "files_with_mixed_math_modes"),
    ("MathML expressions in original", "total_original_mathml"), ("MathML expressions in converted", "total_converted_mathml"), ("WIRIS annotations in converted", "total_converted_wiris_annotations"), ("Canvas equation images in converted", "total_converted_equation_images"),
    ("Raw TeX delimiters in converted", "total_converted_raw_tex_delimiters"), ("Display math blocks in converted", "total_converted_display_math_blocks"), ("Empty MathML stubs in converted", "total_converted_empty_mathml_stubs"),
    ("Absolute equation-image URLs", "total_absolute_equation_image_urls"), ("Equation images missing alt", "total_equation_images_missing_alt"), ("Equation images missing source metadata", "total_equation_images_missing_source"),
]


def math_report(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """The audit of formulas: totals, and the files with something to check."""
    flagged = rows.where(F.size("review_flags") > 0)
    return _report(
        _section(summary, 0, None, ["# Math Audit", "", "## Summary", "", *(_line(f"- {t}: ", c) for t, c in MATH_LINES), "", "## Files With Math Review Flags", ""]),
        _section(flagged, 1, F.col("path").cast("string"), [F.concat(F.lit("- `"), F.col("path").cast("string"), F.lit("`: "), F.array_join("review_flags", ", "))]),
        _section(summary.where("files_with_math_review_flags = 0"), 1, None, ["- None"]),
        _section(summary, 2, None, [""]),
    )


def compatibility_report(uses: DataFrame, limit: int = 20) -> DataFrame:
    """Names of the old template (name, uses, available) against the new one: totals,
    and the ``limit`` most used names without and with an asset."""
    have = F.col("available")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("uses"))), F.lit(0))
    n = lambda c: F.count(F.when(c, 1))
    s = uses.agg(total(F.lit(True)).alias("t"), F.count("*").alias("k"), total(have).alias("m"), n(have).alias("mk"), total(~have).alias("u"), n(~have).alias("uk"))
    pair = lambda label, a, b: F.concat(F.lit(f"- {label} by basename"), F.lit(" in template package: " if label == "Matched" else ": "), F.col(a).cast("string"), F.lit(" hits across "), F.col(b).cast("string"), F.lit(" names"))
    top = lambda c: uses.where(c).orderBy(F.desc("uses"), "name").limit(limit)  # noqa: E731  a report of the largest
    row = [F.concat(F.lit("- "), "name", F.lit(" ("), F.col("uses").cast("string"), F.lit(")"))]
    key = F.concat(_falling(F.col("uses")), F.lit("|"), "name")
    return _report(
        _section(s, 0, None, ["## Brightspace Reference Compatibility", "", _line("- Total Brightspace template reference hits in examples: ", "t"), _line("- Unique Brightspace basenames: ", "k"), pair("Matched", "m", "mk"), pair("Unmatched", "u", "uk"), "", "## Top Unmatched Brightspace Basenames", ""]),
        _section(top(~have), 1, key, row),
        _section(s.where("uk = 0"), 1, None, ["- None"]),
        _section(s, 2, None, ["", "## Top Matched Brightspace Basenames", ""]),
        _section(top(have), 3, key, row),
        _section(s.where("mk = 0"), 3, None, ["- None"]),
    )


def findings_report(counts: DataFrame) -> DataFrame:
    """Findings of the live audit by kind and content, from :func:`links.audit_counts`."""
    one = counts.agg(F.count("*").alias("n"))
    row, key = [F.concat(F.lit("- "), "value", F.lit(": "), F.col("n").cast("string"))], F.concat(_falling(F.col("n")), F.lit("|"), "value")
    parts = []
    for i, (kind, title) in enumerate((("issue_type", "Issue"), ("content_type", "Content"))):
        some = counts.where(F.col("kind") == kind)
        parts += [_section(one, 4 * i, None, [f"## Findings By {title} Type", ""]), _section(some, 4 * i + 1, key, row), _section(some.agg(F.count("*").alias("n")).where("n = 0"), 4 * i + 2, None, ["- none"]), _section(one, 4 * i + 3, None, [""])]
    return _report(*parts)


def write_back_totals(pages: DataFrame) -> DataFrame:
    """Totals of a reviewer's draft written back: pages (found, changed, and counts of
    issues and changes)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return pages.agg(F.count("*").alias("draft_pages"), n(F.col("changed"), "pages_updated"), n(~F.col("found"), "pages_missing"), *(total(c) for c in ("manual_review_issues", "accessibility_issues", "sanitizer_changes", "best_practice_changes")))


def reference_alignment(audits: DataFrame, text: str = "json") -> DataFrame:
    """Counts and ids from the JSON of reference audits; a broken one gives no row."""
    gap = "array<struct<id:string>>"
    kind = f"instruction_comparison struct<critical_gaps:{gap}>, best_practices_coverage struct<coverage_rows:array<struct<id:string,action_needed:boolean>>>, template_analysis struct<placeholder_patterns_detected:array<string>,module_checklist_required_closer_present:boolean>"
    x = F.from_json(F.col(text), kind)
    rows = audits.withColumn("__x", x).where(F.get_json_object(F.col(text), "$").isNotNull())
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    gaps = none(F.col("__x.instruction_comparison.critical_gaps"), gap)
    needed = F.filter(none(F.col("__x.best_practices_coverage.coverage_rows"), "array<struct<id:string,action_needed:boolean>>"), lambda r: F.coalesce(r.action_needed, F.lit(False)))
    ids = lambda xs: F.transform(xs, lambda r: F.trim(F.coalesce(r.id, F.lit(""))))
    t = F.col("__x.template_analysis")
    return rows.select(
        *audits.columns,
        F.size(gaps).cast("long").alias("critical_gap_count"),
        ids(gaps).alias("critical_gap_ids"),
        F.size(needed).cast("long").alias("best_practice_action_needed_count"),
        ids(needed).alias("best_practice_action_needed_ids"),
        none(t.placeholder_patterns_detected, "array<string>").alias("template_placeholder_patterns_detected"),
        F.coalesce(t.module_checklist_required_closer_present, F.lit(True)).alias("module_checklist_required_closer_present"),
    )

import os

import pytest
from pyspark.sql import functions as F

from packloom.operators import package_reports as reports
from packloom.operators import readiness
from packloom.sources import texts

FILES = "package string, path string, changed boolean, changes array<struct<category:string,description:string,count:int>>, manual array<struct<reason:string,evidence:string>>, accessibility array<struct<reason:string,evidence:string>>"
PACKAGES = "package string, input string, output string, rules string, profile string, math string, enforced boolean, manifest boolean"


def tables(spark):
    files = [
        ("a", "b.html", True, [("c", "d", 2)], [("Late", "e"), ("Twice", "e")], [("Alt", "e")]),
        ("a", "a.html", False, [("c", "d", 3), ("c", "f", 1)], [("Twice", "e"), (" ", "x")], []),
        ("a", "c.html", False, None, None, None),
    ]
    packages = [("a", "in.zip", "out.zip", "r.json", "strict", None, True, True), ("b", "in2.zip", "out2.zip", None, "none", "keep", None, False)]
    profiles = spark.createDataFrame([("strict", "Strict one", ["First", "Second"])], "profile string, description string, items array<string>")
    alignment = spark.createDataFrame([("a", "ref.json", ["g1", ""], [], 2, False), ("b", "ref.json", [], [], 0, None)], "package string, source string, critical_ids array<string>, action_ids array<string>, placeholders int, closer_present boolean")
    overlay = spark.createDataFrame([("a", "t.imscc", None, "", "TemplateAssets", 3, 4, 5, 6, None)], "package string, template_package string, alias_map string, report string, asset_dir string, copied int, direct int, alias int, unresolved int, ignored int")
    return spark.createDataFrame(packages, PACKAGES), spark.createDataFrame(files, FILES).repartition(3), profiles, alignment, overlay


REPORT_A = """# LMS Migration Pilot Report

Input zip: `in.zip`
Output zip: `out.zip`
Rules: `r.json`
Policy profile: `strict`
Math handling: `preserve-semantic`
Best-practice enforcer enabled: `True`
IMS manifest found: `True`

## Summary

- HTML files scanned: 3
- HTML files changed: 1
- Automated changes applied: 6
- Manual review issues: 4
- Accessibility issues: 1

## Unresolved / Manual Items

- Files with manual review issues: 2
- Files with accessibility issues: 1
- Top manual review reasons:
  - (2) Twice
  - (1) Late
- Top accessibility reasons:
  - (1) Alt
- Most-affected files:
  - `b.html` (manual: 2, a11y: 1)
  - `a.html` (manual: 2, a11y: 0)

## Template Overlay

- Enabled: `True`
- Template package: `t.imscc`
- Alias map JSON: `none`
- Overlay report JSON: `n/a`
- Materialized template assets dir: `TemplateAssets`
- Materialized assets copied: 3
- Mapped (direct): 4
- Mapped (alias): 5
- Unresolved template refs: 6
- Ignored unresolved framework refs: 0

## Files With Issues

- `a.html`
- `b.html`

## Reference Alignment

- Source: `ref.json`
- Critical instruction gaps: 2
- Best-practice topics needing new rule/report coverage: 0
- Template placeholders detected in template docs: 2
- Module Checklist required closer present in template docs: False
- Critical gap IDs: g1
"""
CHECK_A = """# Migration Preflight Checklist

- Input zip: `in.zip`
- Output zip: `out.zip`
- Policy profile: `strict`
- Profile description: Strict one

## Automated Summary

- HTML files scanned: 3
- HTML files changed: 1
- Manual review issues: 4
- Accessibility issues: 1

## Required Verifications Before Release

- [ ] First
- [ ] Second

## Findings-Based Follow-Up

### Manual Review Reasons

- [ ] (2) Twice
- [ ] (1) Late

### Accessibility Reasons

- [ ] (1) Alt

## Reference Alignment Follow-Up

- [ ] Resolve `2` critical instruction gap(s) identified in reference audit.
- [ ] Update template/rules to enforce Module Checklist closing reminder.
- [ ] Verify unresolved template placeholders are cleaned up before release.
"""


def test_reports_are_written(spark, tmp_path):
    packages, files, profiles, alignment, overlay = tables(spark)
    at = str(tmp_path / "r")
    texts.write_texts(reports.conversion_reports(packages, files, overlay, alignment), at, reports.ORDER)
    assert sorted(os.listdir(at)) == ["a.md", "b.md"] and (tmp_path / "r/a.md").read_text() == REPORT_A
    b = (tmp_path / "r/b.md").read_text()
    assert "Math handling: `keep`" in b and "- HTML files scanned: 0" in b and b.count("- None") == 1 and "## Template Overlay" not in b and "Rules: ``" in b
    texts.write_texts(reports.conversion_reports(packages, files).where("package = 'b'"), at, reports.ORDER)
    assert os.listdir(at) == ["b.md"] and "Reference Alignment" not in (tmp_path / "r/b.md").read_text()


def test_checklists_are_written(spark, tmp_path):
    packages, files, profiles, alignment, _ = tables(spark)
    texts.write_texts(reports.preflight_checklists(packages, files, profiles, alignment), str(tmp_path / "c"), reports.ORDER, ".txt")
    assert (tmp_path / "c/a.txt").read_text() == CHECK_A
    b = (tmp_path / "c/b.txt").read_text()
    assert "- [ ] No issues flagged by automation.\n" in b and "- [ ] Review manual findings and" in b and b.endswith("no unresolved governance gaps.\n")


def test_writer_keeps_order_and_refuses_what_has_no_name(spark, tmp_path):
    lines = spark.range(5000).select((F.col("id") % 3).cast("string").alias("package"), F.col("id").alias("n"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("é"), F.col("id"))).alias("line"))
    at = str(tmp_path / "t")
    texts.write_texts(lines.repartition(7), at, ["n"])
    assert (tmp_path / "t/1.md").read_text().split("\n") == [f"é{i}" if i % 7 else "" for i in range(1, 5000, 3)]
    with pytest.raises(Exception, match="no name"):
        texts.write_texts(lines.withColumn("package", F.lit("")), at, ["n"])
    with pytest.raises(Exception, match="there already"):
        texts.write_texts(lines, at, ["n"], overwrite=False)
    assert sorted(os.listdir(at)) == ["0.md", "1.md", "2.md"]


def test_readiness(spark):
    rows = [
        ("new", "visual_audit", 1, "v", None, {}),
        ("conv", "migration_report", 5, "m", None, {"changes": 7}), ("conv", "page_review", 4, "old", None, {"high_priority": 3}),
        ("pages", "migration_report", 5, "m", None, {}), ("pages", "page_review", 5, "p", None, {"high_priority": 3}),
        ("imp", "approval_report", 9, "a", "Approved", {"score": 88}), ("imp", "migration_report", 1, "m", None, {}),
        ("done", "approval_report", 9, "a", " approved", {}), ("done", "snapshot", 9, "s", None, {}),
        ("list", "approval_report", 9, "a", "", {}), ("list", "issues", 9, "s", None, {"count": 2}),
        ("post", "approval_report", 9, "a", "approved", {}), ("post", "issues", 9, "s", None, {"count": 2}), ("post", "issues_post", 1, "s", None, {"count": 0}), ("post", "live_audit", 9, "l", None, {"findings": 1}),
        ("tie", "migration_report", 5, "a", None, {"changes": 1}), ("tie", "migration_report", 5, "b", None, {"changes": 2}),
    ]
    df = spark.createDataFrame(rows, "package string, kind string, at long, name string, status string, numbers map<string,bigint>")
    got = {r.package: r for r in readiness.readiness(df).collect()}
    assert {k: r.step for k, r in got.items()} == {"new": "prepare", "conv": "review", "pages": "pages", "imp": "import", "done": "done", "list": "checklist", "post": "checklist", "tie": "review"}
    assert got["conv"].review == "none" and got["conv"].changes == 7 and got["new"].review == "visual_audit" and got["tie"].changes == 2
    assert got["list"].review_status == "unknown" and got["post"].issues == 0 and got["imp"].score == 88 and got["done"].next_step == readiness.STEPS["done"]


def lines_of(df, package="a"):
    return "\n".join(r.line for r in df.where(F.col("package") == package).orderBy(*reports.ORDER).collect())


def test_safe_summaries(spark):
    packages, files, *_ = tables(spark)
    got = reports.safe_summaries(packages, files)
    assert lines_of(got) == "SUMMARY\npolicy_profile: strict\nhtml_files_scanned: 3\nhtml_files_changed: 1\ntotal_automated_changes: 6\nmanual_review_issues: 4\naccessibility_issues: 1\n\nMANUAL_REVIEW_REASON_COUNTS\n2 | Twice\n1 | Late\n\nACCESSIBILITY_REASON_COUNTS\n1 | Alt\n"
    assert lines_of(got, "b").endswith("MANUAL_REVIEW_REASON_COUNTS\n0 | none\n\nACCESSIBILITY_REASON_COUNTS\n0 | none\n")


def test_other_reports(spark):
    visual = spark.createDataFrame([("a", *range(len(reports.VISUAL)))], "package string, " + ", ".join(f"{c} int" for _, c in reports.VISUAL))
    text = lines_of(reports.visual_reports(visual)).split("\n")
    assert text[:5] == ["# Visual Audit", "", "## Summary", "", "- Files scanned: 0"] and text[-2] == "- WIRIS annotation nodes remaining in converted: 10" and text[-1] == ""
    snap = spark.createDataFrame([("a", "now", "u", "7", "N", None, 1, 2, 3, 4, 5, None, "j", "m")], "package string, generated string, base_url string, course_id string, name string, code string, pages int, modules int, files int, assignments int, discussions int, announcements int, json string, markdown string")
    text = lines_of(reports.snapshot_reports(snap))
    assert "- Course Code: ``\n\n## Counts\n\n- Pages: 1\n" in text and "- Announcements: 0\n" in text and text.endswith("- Snapshot Markdown: `m`")


def test_practice_reports(spark):
    t = spark.createDataFrame([("a", "in.csv", 9), ("b", "x.csv", 0)], "package string, input string, rows int")
    same = spark.createDataFrame([("a", "g2", 9), ("a", "g1", 11), ("a", "g2", 2), ("a", "g1", 4)], "package string, group string, row int")
    against = spark.createDataFrame([("a", "quiz", 5), ("a", "quiz", 3)], "package string, source string, row int")
    near = spark.createDataFrame([("a", i, i + 1, "0.95") for i in range(2, 32)], "package string, left_row int, right_row int, similarity string")
    text = lines_of(reports.practice_reports(t, same, against, near))
    assert "- Exact duplicates: 2\n- Potential conflicts: 1\n- Potential redundancies: 30\n\n## Duplicate Groups\n\n- Rows: 2, 9\n- Rows: 4, 11\n\n## Conflict Groups\n\n- Source key `quiz` in rows: 3, 5\n\n## Redundancy Candidates\n\n- Rows 2 and 3 (similarity: 0.95)\n" in text
    assert text.count("similarity") == 25 and text.endswith("\n") and lines_of(reports.practice_reports(t, same, against, near), "b").endswith("- Potential redundancies: 0\n")


def test_corpus_reports(spark):
    corpora = spark.createDataFrame([("a", "now", "ex", "sn")], "package string, generated string, examples string, snapshots string")
    overall = spark.createDataFrame([("a", "courses", 2), ("a", "all", 5)], "package string, key string, value int")
    columns = ", ".join(f"{k} int" for _, k in reports.CORPUS)
    courses = spark.createDataFrame([("a", "X2", "x2.zip", None, None, None, *range(8), None, None, None), ("a", "X1", "x1.zip", "s.json", "7", "C", *range(8), 1, None, 3)], f"package string, course string, source string, snapshot string, snapshot_id string, snapshot_code string, {columns}, pages int, modules int, files int")
    skipped = spark.createDataFrame([("a", "Z", "no package")], "package string, course string, reason string")
    text = lines_of(reports.corpus_reports(corpora, overall, courses, skipped))
    assert "## Overall\n\n- all: 5\n- courses: 2\n\n## Per Course\n\n### X1\n- Source package: `x1.zip`\n- Snapshot JSON: `s.json`\n- Snapshot course: `7` | `C`\n- D2L html files: 0\n" in text
    assert "- Gold snapshot pages/modules/files: 1/0/3\n\n### X2\n" in text and "`(not found)`\n- D2L html" in text and text.endswith("files: n/a\n\n## Skipped Folders\n\n- Z: no package\n")

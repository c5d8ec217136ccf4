"""Findings as a fact table, their rankings, and the checklist built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKLIST = "priority string, source string, category string, owner string, description string, action string, count long, reference string"

#: Fixed values. Import issues: what the description holds (or, with ^, starts
#: with), priority, category, owner and action; the first that holds decides.
IMPORT_LADDER = [
    ("couldn't determine the correct answers", "P1", "quiz_answer_key", "Faculty/ID", "Open the question and set/verify correct answer(s), points, and feedback in Canvas."),
    ("missing links found in imported content - wiki page body", "P1", "missing_page_link", "ID", "Open page, relink missing resources to Canvas destinations, save, and republish."),
    ("missing links found in imported content - announcement message", "P2", "missing_announcement_link", "ID", "Edit announcement links to Canvas resources or remove broken legacy links."),
    ("missing links found in imported content - assignment description", "P1", "missing_assignment_link", "ID", "Open assignment instructions, relink missing resources to Canvas files/pages, and resave."),
    ("missing links found in imported content - assessment question question_text", "P1", "missing_assessment_question_link", "Faculty/ID", "Open quiz question text and relink or remove unresolved references."),
    ("^Import Error: Module Item - ", "P1", "module_item_import_error", "ID", "Open module and resolve missing/failed item import, replacing with the correct Canvas item."),
    ("^Import Error: Quiz - ", "P1", "quiz_import_error", "Faculty/ID", "Open quiz settings/questions and rebuild missing items as needed."),
]
IMPORT_DEFAULT = ("P2", "canvas_import_warning", "ID", "Review warning and resolve in Canvas.")
#: Review reasons: what the reason holds, priority, category, owner and action.
REVIEW_LADDER = [
    ("legacy script blocks", "P1", "html_script_cleanup", "ID", "Remove legacy script behavior and verify page rendering in Canvas."),
    ("embedded iframe", "P1", "embedded_iframe_review", "ID", "Review each iframe for accessibility, security, and responsive behavior."),
    ("lti tool embed", "P1", "lti_embed_reconfiguration", "ID", ""),
    ("template placeholder text remains", "P1", "template_placeholder_cleanup", "Faculty/ID", "Replace unresolved template placeholders with final course-specific content."),
    ("template asset reference not mapped to canvas template package", "P1", "template_asset_mapping_review", "ID", "Map unresolved Brightspace template assets to approved Canvas template assets and re-run migration."),
    ("legacy d2l links were neutralized", "P1", "relink_neutralized_d2l_links", "ID", "Replace neutralized D2L links with valid Canvas links."),
    ("question bank migration requires manual verification", "P1", "question_bank_logic_review", "Faculty/ID", "Rebuild question-pool logic in Canvas, verify draw counts/randomization, and share any required item banks with the course so coordinators can edit them."),
    ("youtube embeds may violate ad-free requirement", "P2", "youtube_hosting_review", "Faculty/ID", "Confirm hosting approach (for example Canvas Studio or approved platform)."),
    ("announcement migration behavior is non-standard", "P2", "announcement_settings_review", "ID", "Verify announcement posting state and notification behavior in Canvas."),
    ("panopto embed requires permissions", "P1", "panopto_permissions_review", "ID", "Validate Panopto folder permissions and embed behavior for students."),
    ("h5p content requires manual conversion", "P2", "h5p_conversion_decision", "ID", "Replace or rebuild H5P content using approved Canvas-compatible workflow."),
    ("scorm packages require upload", "P1", "scorm_upload_workflow", "ID", "Re-import SCORM package through Canvas SCORM integration workflow."),
]
#: Further rungs for accessibility findings.
ACCESS_LADDER = [
    ("image missing alt attribute", "P1", "a11y_alt_text", "Faculty/ID", "Add meaningful alt text or mark decorative images appropriately."),
    ("image alt attribute is empty", "P1", "a11y_alt_text", "Faculty/ID", "Add meaningful alt text or mark decorative images appropriately."),
    ("heading level jump detected", "P2", "a11y_heading_order", "Faculty/ID", "Fix heading hierarchy to avoid level jumps."),
    ("table missing caption", "P2", "a11y_table_caption", "Faculty/ID", "Add table captions and header associations as needed."),
    ("non-descriptive link text", "P2", "a11y_link_text", "Faculty/ID", "Replace vague link text with descriptive labels."),
]
REVIEW_DEFAULT = ("P2", "manual_review_item", "ID", "Review and resolve this migration finding.")


def _rung(priority: str, category: str, owner: str, action: str | Column) -> Column:
    return F.struct(F.lit(priority).alias("priority"), F.lit(category).alias("category"), F.lit(owner).alias("owner"), (F.lit(action) if isinstance(action, str) else action).alias("action"))


def _holds(text: Column, mark: str) -> Column:
    return F.startswith(text, F.lit(mark[1:])) if mark[0] == "^" else F.contains(F.lower(text), F.lit(mark))


def import_rung(description: Column) -> Column:
    """struct<priority, category, owner, action> of an import issue."""
    return F.coalesce(*(F.when(_holds(description, m), _rung(*rest)) for m, *rest in IMPORT_LADDER), _rung(*IMPORT_DEFAULT))


def review_rung(kind: Column, reason: Column) -> Column:
    tool = F.regexp_extract(F.lower(reason), r"lti tool embed \(([^)]+)\)", 1)
    name = F.when(tool != "", F.initcap(tool)).otherwise("LTI tool")
    embed = F.concat(F.lit("Re-embed "), name, F.lit(" using the Canvas LTI integration (Settings → Apps → "), name, F.lit(") rather than the raw D2L src URL, which will not resolve after migration."))
    rungs = [F.when(_holds(reason, m), _rung(*rest[:3], rest[3] or embed)) for m, *rest in REVIEW_LADDER]
    rungs += [F.when((kind == "accessibility") & _holds(reason, m), _rung(*rest)) for m, *rest in ACCESS_LADDER]
    return F.coalesce(*rungs, _rung(*REVIEW_DEFAULT))


def explode_issues(df: DataFrame, path: str, manual: Column, access: Column) -> DataFrame:
    """DataFrame[path, type, pos, reason, evidence], manual findings first."""
    tag = lambda xs, kind: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("type"), x.reason.alias("reason"), x.evidence.alias("evidence")))
    rows = df.select(F.col(path).alias("path"), F.posexplode(F.concat(tag(manual, "manual"), tag(access, "accessibility"))).alias("pos", "x"))
    return rows.select("path", "x.type", "pos", "x.reason", "x.evidence")


def reason_counts(issues: DataFrame) -> DataFrame:
    """Findings and files of each reason."""
    return issues.groupBy("type", "reason").agg(F.count("*").alias("n_issues"), F.countDistinct("path").alias("n_files"))


def top_reasons(issues: DataFrame, limit: int = 15) -> DataFrame:
    """The most common reasons; ties go to the reason that was seen first."""
    n = issues.groupBy("reason").agg(F.count("*").alias("n"), F.min(F.struct("path", "pos")).alias("first_seen"))
    return n.orderBy(F.desc("n"), "first_seen").limit(limit).select("reason", "n")


def top_files(issues: DataFrame, limit: int = 20) -> DataFrame:
    n = issues.groupBy("path").agg(F.count("*").alias("total"), F.count(F.when(F.col("type") == "manual", 1)).alias("manual"))
    return n.orderBy(F.desc("total"), F.desc("manual"), "path").limit(limit)


def grouped_review(issues: DataFrame) -> DataFrame:
    """Count, number of files and the first three files of each finding. What is
    gathered per finding is three paths, kept while the counts are summed."""
    by_file = issues.groupBy("type", "reason", "path").agg(F.count("*").alias("n"))
    w = Window.partitionBy("type", "reason").orderBy("path")
    ranked = by_file.withColumn("r", F.row_number().over(w))
    rows = ranked.groupBy("type", "reason").agg(F.sum("n").alias("n"), F.count("*").alias("files"), F.sort_array(F.collect_list(F.when(F.col("r") <= 3, F.col("path")))).alias("sample"))
    return rows.select("type", "reason", "n", "files", F.array_join("sample", ", ").alias("sample"))


def review_checklist(issues: DataFrame, source: str = "manual-review.csv") -> DataFrame:
    """An item for each finding, with the number of its rows and three of its files."""
    g = grouped_review(issues).withColumn("x", review_rung(F.col("type"), F.col("reason")))
    reference = F.when(F.col("sample") == "", source).otherwise(F.concat(F.lit(f"{source} | sample files: "), F.col("sample")))
    return g.select("x.priority", F.lit("manual_review").alias("source"), "x.category", "x.owner", F.col("reason").alias("description"), "x.action", F.col("n").alias("count"), reference.alias("reference"))


def import_checklist(issues: DataFrame) -> DataFrame:
    """An item for each issue (description, reference) of an import."""
    d = F.trim(F.coalesce("description", F.lit("")))
    rows = issues.withColumn("x", import_rung(d))
    return rows.select("x.priority", F.lit("canvas_import").alias("source"), "x.category", "x.owner", F.when(d == "", "Canvas import warning").otherwise(d).alias("description"), "x.action", F.lit(1).cast("long").alias("count"), F.trim(F.coalesce("reference", F.lit(""))).alias("reference"))


#: Fixed values. Practices that the audit of reference documents may miss: id,
#: priority, owner and action.
PRACTICE_LADDER = [
    ("item_bank_sharing", "P1", "ID/Faculty", "After rebuilding or copying quiz banks, open Item Banks, share each required bank with the course, and verify the course coordinator can edit the questions."),
    ("question_library_rebuild", "P1", "ID/Faculty", "For quizzes that used D2L question libraries, rebuild question pools from Canvas item banks and verify scoring, settings, and random draw behavior."),
    ("rubric_use_for_grading", "P1", "Faculty/ID", "Open each migrated rubric, fix formatting/points/outcomes as needed, reconnect it to the assessment, and enable Use this rubric for grading where required."),
    ("studio_video_workflow", "P1", "ID", "If a course used D2L media-library videos, move them into course-owned Canvas Studio or another approved course-owned location, replace embeds, and verify student playback."),
    ("mobile_view_review", "P2", "Faculty/ID", "Use browser device emulation or Canvas mobile tooling to verify the final course pages and assessments in a mobile-sized view before release."),
]
PRACTICE_DEFAULT = ("P2", "ID Lead", "Add explicit rule, trigger, or preflight check to cover this best-practice topic.")
PHRASE_ACTION = "Decide whether to encode this guidance into migration rules, checklist, or process docs."
CLOSER_ITEM = ("P1", "reference_template_mc_closer", "ID Lead", "Template missing required Module Checklist closing reminder.", "Update template and migration validation to enforce required checklist closer.")
PLACEHOLDER_ITEM = ("P2", "reference_template_placeholders", "ID Lead", "Template documents contain placeholder patterns.", "Confirm placeholders are intentional template tokens and enforce final cleanup rules.")


def practice_rung(id: Column) -> Column:
    """struct<priority, owner, action> of a practice that is not covered."""
    rung = lambda p, o, a: F.struct(F.lit(p).alias("priority"), F.lit(o).alias("owner"), F.lit(a).alias("action"))
    key = F.lower(F.trim(F.coalesce(id, F.lit(""))))
    return F.coalesce(*(F.when(key == i, rung(*rest)) for i, *rest in PRACTICE_LADDER), rung(*PRACTICE_DEFAULT))


def reference_checklist(gaps: DataFrame, practices: DataFrame, template: DataFrame, source: str = "reference-audit.json") -> DataFrame:
    """Items from the audit of reference documents: critical phrases that are missing,
    ``gaps`` (id, phrase, rationale); practices without rule or finding, ``practices``
    (id, label, action_needed); and ``template``, one row (closer_present, placeholders)."""

    def rows(df: DataFrame, priority, category, owner, description, action, reference) -> DataFrame:
        text = lambda c: F.lit(c) if isinstance(c, str) else c
        return df.select(text(priority).alias("priority"), F.lit("reference_audit").alias("source"), text(category).alias("category"), text(owner).alias("owner"), text(description).alias("description"), text(action).alias("action"), F.lit(1).cast("long").alias("count"), text(reference).alias("reference"))

    tag = lambda kind, default: F.concat(F.lit(f"reference_{kind}:"), F.coalesce(F.col("id"), F.lit(default)))
    phrase, label = F.trim("phrase"), F.trim("label")
    out = rows(gaps.where(phrase != ""), "P2", tag("instruction_gap", "gap"), "ID Lead", phrase, PHRASE_ACTION, F.trim(F.coalesce("rationale", F.lit(""))))
    needed = practices.where(F.col("action_needed") & (label != "")).withColumn("x", practice_rung(F.col("id")))
    out = out.unionByName(rows(needed, F.col("x.priority"), tag("best_practice_gap", "coverage"), F.col("x.owner"), label, F.col("x.action"), source))
    out = out.unionByName(rows(template.where(~F.coalesce("closer_present", F.lit(True))), *CLOSER_ITEM, source))
    found = F.array_join(F.slice("placeholders", 1, 5), ", ")
    return out.unionByName(rows(template.where(F.size("placeholders") > 0), *PLACEHOLDER_ITEM, found))


#: Fixed values. Checks that every package needs: category, owner, description, action.
STANDARD_TASKS = [
    ("gradebook_structure", "ID", "Verify Canvas Gradebook assignment groups, weights, and drop rules", "Open Gradebook → Assignment Groups.  Recreate D2L category weights, confirm assignment group totals match D2L, and configure drop-lowest/drop-highest rules for any activity with student-drop policies."),
    ("bonus_extra_credit", "ID/Faculty", "Verify bonus / extra-credit assignments are configured correctly", "In Canvas, extra-credit assignments must be worth 0 points and have an attached rubric (or a manual points entry).  Find any D2L 'bonus' items and set them up in Canvas accordingly.  Confirm they do not count against the total points denominator."),
    ("syllabus_quiz_gate", "ID/Faculty", "Verify Syllabus Quiz / prerequisite-gating is re-implemented in Canvas", "If the D2L course gated module access with a Syllabus Quiz (quiz set to 'Not in Gradebook'), recreate the prerequisite using Canvas Module Requirements (complete the quiz before proceeding) and verify the quiz is excluded from grade calculations."),
    ("faculty_only_content", "ID", "Verify instructor-only / faculty-only pages are unpublished in Canvas", "Identify D2L pages restricted to Staff/Instructor roles (release conditions).  In Canvas, set those pages to Unpublished and add '(Instructor Only)' to the page title per naming convention so they are excluded from student view."),
    ("rubric_configuration", "ID/Faculty", "Verify rubric point ranges, criteria, and grading connections in Canvas", "Open each migrated rubric in Canvas.  Check that criterion point ranges are correct (D2L and Canvas range differently), attach the rubric to its assignment, and enable 'Use this rubric for grading' on graded assessments."),
    ("item_bank_sharing", "ID", "Share item banks with course coordinator after quiz migration", "After rebuilding quiz question banks, open Canvas Item Banks, share each required bank at the course level, and confirm the course coordinator can view and edit questions.  This is required before the course goes live for multi-section courses."),
]


def standard_tasks(spark: SparkSession) -> DataFrame:
    """Checks that every package needs."""
    return spark.createDataFrame([("P2", "standard_migration", c, o, d, a, 1, "") for c, o, d, a in STANDARD_TASKS], CHECKLIST)


def priority_rank(priority: Column) -> Column:
    p = F.upper(F.trim(priority))
    return F.when(p.isin("P0", "P1", "P2", "P3"), F.substring(p, 2, 1).cast("int")).otherwise(9)


def checklist(*parts: DataFrame) -> DataFrame:
    """All parts, ordered by priority, source, category and description."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(priority_rank(F.col("priority")), "source", "category", "description")


def checklist_rows(items: DataFrame) -> DataFrame:
    """The checklist as a sheet for people to fill in."""
    return items.select("priority", "source", "category", "owner", "description", "action", "count", "reference", F.lit("todo").alias("status"), F.lit("").alias("notes"))


def checklist_counts(items: DataFrame) -> DataFrame:
    """Items by priority, by source and by category, in one pass."""
    g = items.groupingSets([["priority"], ["source"], ["category"]], "priority", "source", "category").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("priority", "source", "category").alias("value"), F.when(F.col("priority").isNotNull(), "priority").when(F.col("source").isNotNull(), "source").otherwise("category").alias("kind"), "n")

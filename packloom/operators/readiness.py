"""How far packages are on their way, by the reports that there are of them.

One aggregation takes the latest report of each kind of a package; what was made before
the latest conversion doesn't count. Ordered rules then tell the state of the package, of
its review and of the course, and the next step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONVERSION = "migration_report"
#: Kinds of reports, and of review the one that counts, best first.
KINDS = ["visual_audit", "math_audit", "page_review", "approval_report", "pattern_report", "snapshot", "issues_post", "issues", "live_audit"]
REVIEWS = ["approval_report", "pattern_report", "page_review", "math_audit", "visual_audit"]
# The next step by what is there.
STEPS = {
    "prepare": "Next step: choose a D2L zip and click Prepare Canvas Package.",
    "review": "Next step: click Review Readiness before upload, or import the package into Canvas.",
    "pages": "Next step: review the high-priority pages in the page review workbench before upload.",
    "import": "Next step: import into Canvas, then run Canvas Cleanup + Audit and Capture Course Snapshot.",
    "done": "Next step: the course is in a strong state for handoff or final Canvas spot-checks.",
    "checklist": "Next step: work the remaining checklist items, then rerun Review Readiness.",
}


def latest_reports(reports: DataFrame, package: str = "package") -> DataFrame:
    """DataFrame[package, a struct (at, name, status, numbers) for each kind] of reports
    (package, kind, at, name, status, numbers map<string,bigint>): the latest of each kind,
    of equal times that with the larger name, and only if it is not older than the latest
    conversion, where there is one. A list of issues after the import stands for the one
    before it, even if it is older."""
    row = F.struct("at", "name", "status", "numbers")
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, row), F.when(F.col("kind") == kind, F.struct("at", "name"))).alias(kind)
    g = reports.where("at IS NOT NULL").groupBy(package).agg(*(last(k) for k in (CONVERSION, *KINDS)))
    g = g.withColumn("issues", F.coalesce("issues_post", "issues")).drop("issues_post")
    since = F.col(f"{CONVERSION}.at")
    return g.select(package, CONVERSION, *(F.when(since.isNull() | (F.col(f"{k}.at") >= since), F.col(k)).alias(k) for k in KINDS if k != "issues_post"))


def readiness(reports: DataFrame, package: str = "package") -> DataFrame:
    """DataFrame[package, converted, changes, manual, accessibility, review, review_status,
    score, high_pages, gaps, math_flags, imported, issues, findings, step, next_step].

    ``review`` is the best report of a review; ``imported`` tells whether a snapshot, issues
    or findings are there. Missing numbers are 0.
    """
    w = latest_reports(reports, package)
    has = lambda k: F.col(k).isNotNull()

    def n(kind: str, name: str) -> Column:
        return F.coalesce(F.element_at(F.col(f"{kind}.numbers"), name), F.lit(0)).cast("long")

    issues, findings, high = n("issues", "count"), n("live_audit", "findings"), n("page_review", "high_priority")
    imported = has("snapshot") | (issues > 0) | (findings > 0)
    status = F.lower(F.trim(F.coalesce(F.col("approval_report.status"), F.lit(""))))
    step = (
        F.when(has("approval_report") & ~imported, "import")
        .when(has("approval_report") & (status == "approved") & (issues == 0) & (findings == 0), "done")
        .when(has("approval_report"), "checklist")
        .when(has("page_review") & (high > 0), "pages")
        .when(has(CONVERSION), "review")
        .otherwise("prepare")
    )
    review = F.coalesce(*(F.when(has(k), k) for k in REVIEWS), F.lit("none"))
    wording = F.create_map(*(F.lit(x) for pair in STEPS.items() for x in pair))
    return w.select(
        package,
        has(CONVERSION).alias("converted"),
        n(CONVERSION, "changes").alias("changes"),
        n(CONVERSION, "manual").alias("manual"),
        n(CONVERSION, "accessibility").alias("accessibility"),
        review.alias("review"),
        F.when(has("approval_report"), F.when(status == "", "unknown").otherwise(status)).alias("review_status"),
        n("approval_report", "score").alias("score"),
        high.alias("high_pages"),
        n("pattern_report", "gaps").alias("gaps"),
        n("math_audit", "flags").alias("math_flags"),
        imported.alias("imported"),
        issues.alias("issues"),
        findings.alias("findings"),
        step.alias("step"),
    ).withColumn("next_step", F.element_at(wording, F.col("step")))

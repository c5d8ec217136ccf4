"""Reports: fact tables, their summary, and short texts made from the summary.

The facts stay distributed and are written by Spark; only the summary, a bounded
number of rows, comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.operators.findings import reason_counts, top_files, top_reasons


def file_summary(files: DataFrame) -> DataFrame:
    """Totals of results (path, changed, changes, manual, accessibility)."""
    count = F.aggregate("changes", F.lit(0).cast("long"), lambda a, c: a + c["count"])
    return files.agg(
        F.count("*").alias("files"),
        F.count(F.when(F.col("changed"), 1)).alias("changed_files"),
        F.coalesce(F.sum(count), F.lit(0)).alias("changes"),
        F.coalesce(F.sum(F.size("manual")), F.lit(0)).alias("manual_issues"),
        F.coalesce(F.sum(F.size("accessibility")), F.lit(0)).alias("accessibility_issues"),
        F.count(F.when(F.size("manual") > 0, 1)).alias("files_with_manual_issues"),
        F.count(F.when(F.size("accessibility") > 0, 1)).alias("files_with_accessibility_issues"),
    )


def write_review_csv(issues: DataFrame, path: str) -> None:
    """file, type, reason, evidence; manual findings of a file come first."""
    rows = issues.orderBy("path", F.desc("type"), "pos").select(F.col("path").alias("file"), "type", "reason", "evidence")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def issue_summary(issues: DataFrame) -> dict:
    """Reasons by type, the top reasons and files, as plain values."""
    part = lambda kind: [r.asDict() for r in top_reasons(issues.where(F.col("type") == kind)).collect()]
    return {"top_manual_review_reasons": part("manual"), "top_accessibility_reasons": part("accessibility"), "top_issue_files": [r.asDict() for r in top_files(issues).collect()]}


def safe_summary(summary: dict, issues: DataFrame) -> str:
    """Counts only, with no text of any page."""
    lines = [f"- {k.replace('_', ' ').capitalize()}: {v}" for k, v in summary.items()]
    rows = reason_counts(issues).orderBy(F.desc("n_issues"), "reason").limit(15).collect()
    return "\n".join(["# Summary", *lines, "", "## Reasons", *(f"- {r.reason}: {r.n_issues}" for r in rows)]) + "\n"


def next_steps(ordered: DataFrame, limit: int = 3) -> DataFrame:
    """The first different actions of (rank, action) rows."""
    first = ordered.groupBy("action").agg(F.min("rank").alias("rank"))
    return first.orderBy("rank", "action").limit(limit)

"""Audit of practice tables: duplicates, conflicts and near-equal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.arrow import similarity
from packloom.functions.html import fold, header_key
from packloom.runtime import materialise

#: Header names, without punctuation, of each column.
HEADERS = {
    "row_id": ["id", "ruleid", "recommendationid", "guidelineid", "key"],
    "source": ["source", "d2lfeature", "from", "origin", "currentstate", "item"],
    "recommendation": ["recommendation", "bestpractice", "action", "suggestedaction", "guidance", "recommendedaction"],
    "target": ["target", "canvasequivalent", "to", "canvasmapping", "destination"],
    "notes": ["notes", "details", "rationale", "accessibility", "wcag", "comments"],
    "category": ["category", "type", "domain", "module", "contenttype"],
}


def practice_rows(raw: DataFrame, order: str) -> DataFrame:
    """Columns resolved by header, rows numbered from 2, empty rows left out."""
    import re

    plain = {c: re.sub("[^a-z0-9]", "", c.strip().lower()) for c in raw.columns}
    pick = {k: next((c for c in raw.columns if plain[c] in names and c != order), None) for k, names in HEADERS.items()}
    cols = [(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) if c else F.lit("")).alias(k) for k, c in pick.items()]
    # Rows are numbered by the place in their part of the order; the parts before it
    # are counted, so no task gets all rows.
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = materialise(raw.select(F.col(order).alias("__o"), *cols).orderBy("__o").select("*", part.alias("__part"), place.alias("__at")), "practice-rows")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row for each part
    rows = parts.join(before, "__part").select((F.col("__before") + F.col("__at") + 2).alias("row_number"), *HEADERS)
    return rows.where(F.concat_ws("", *HEADERS) != "")


def fingerprint(*columns: str) -> Column:
    return F.concat_ws(" | ", *(fold(F.coalesce(F.col(c), F.lit(""))) for c in columns))


def duplicates(rows: DataFrame, key: Column, row: str) -> DataFrame:
    """Groups of more than one row with an equal key: size, excess, first row."""
    g = rows.groupBy(F.sha2(key, 256).alias("fingerprint")).agg(F.count("*").alias("n"), F.min(row).alias("first_row"))
    return g.where("n > 1").withColumn("excess", F.col("n") - 1)


def conflicts(rows: DataFrame, source: Column, advice: Column) -> DataFrame:
    """Sources with two or more different pieces of advice."""
    r = rows.select(fold(source).alias("source_key"), fold(advice).alias("advice")).where("source_key <> ''")
    g = r.groupBy("source_key").agg(F.count("*").alias("n_rows"), F.countDistinct(F.when(F.col("advice") != "", F.col("advice"))).alias("n_advice"))
    return g.where("n_advice > 1")


def fuzzy_pairs(rows: DataFrame, row: str, text: Column, key: Column, threshold: float = 0.9) -> DataFrame:
    """Pairs of rows, the earlier one first, whose ratio reaches the threshold and
    whose keys differ.

    A ratio of r needs 2 * min / (a + b) >= r of the lengths, and as many shared
    characters; so a row meets those of its own length class and the classes next
    to it, and letter counts are compared before the ratio is computed.
    """
    letters = "abcdefghijklmnopqrstuvwxyz "
    base = rows.select(F.col(row).alias("id"), fold(text).alias("t"), F.sha2(key, 256).alias("k")).where("t <> ''")
    step = (2 - threshold) / threshold
    import math

    base = base.withColumn("c", F.floor(F.log(F.length("t").cast("double")) / math.log(step)).cast("int"))
    base = base.withColumn("h", F.array(*(F.length("t") - F.length(F.replace("t", F.lit(x), F.lit(""))) for x in letters)))
    left = base.select(F.col("id").alias("left_id"), F.col("t").alias("lt"), F.col("k").alias("lk"), F.col("h").alias("lh"), F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"))
    right = base.select(F.col("id").alias("right_id"), F.col("t").alias("rt"), F.col("k").alias("rk"), F.col("h").alias("rh"), "c")
    j = left.join(right, "c").where("left_id < right_id and lk <> rk")
    most = F.length("lt") + F.length("rt")
    shared = F.aggregate(F.zip_with("lh", "rh", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: s + x)
    j = j.where(2 * F.least(F.length("lt"), F.length("rt")) >= threshold * most).where(most - shared >= threshold * most)
    return j.withColumn("score", similarity("lt", "rt")).where(F.col("score") >= threshold).select("left_id", "right_id", "score")


__all__ = ["HEADERS", "conflicts", "duplicates", "fingerprint", "fuzzy_pairs", "header_key", "practice_rows"]

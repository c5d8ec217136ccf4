"""Per-page measures, drift between two versions of a page, and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.html import attribute, compare_key, count_of, decode_basic, headings, matches, plain_text, title_text

#: What is counted, by name.
TAG_PATTERNS = {
    "heading_count": r"(?i)<h[1-6]\b",
    "image_count": r"(?i)<img\b",
    "iframe_count": r"(?i)<iframe\b",
    "table_count": r"(?i)<table\b",
    "list_count": r"(?i)<(?:ul|ol)\b",
    "accordion_count": r"(?i)<details\b",
    "divider_count": r"(?i)<hr\b",
    "link_count": r"(?i)<a\b",
    "template_icon_count": r"(?i)<img\b[^>]*templateassets/[^>]*>",
}


def content_metrics(text: Column) -> dict[str, Column]:
    out = {k: count_of(text, p) for k, p in TAG_PATTERNS.items()}
    out["word_count"] = count_of(plain_text(text, drop_scripts=True), r"(?U)\b\w+\b")
    return out


def metric_drift(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Reasons why a page's content looks changed."""
    b, a = before, after

    def changed(what: str, key: str) -> Column:
        return F.concat(F.lit(f"{what} changed "), b[key].cast("string"), F.lit(" -> "), a[key].cast("string"), F.lit("."))

    words = F.abs(a["word_count"] - b["word_count"]) / F.greatest(b["word_count"], F.lit(1))
    return F.array_compact(
        F.array(
            F.when((b["image_count"] > 0) & (a["image_count"] == 0), F.lit("Converted page removed all images from the original page.")).when(F.abs(b["image_count"] - a["image_count"]) >= 2, changed("Image count", "image_count")),
            F.when(F.abs(b["heading_count"] - a["heading_count"]) >= 2, changed("Heading count", "heading_count")),
            F.when(b["iframe_count"] != a["iframe_count"], changed("Embedded iframe count", "iframe_count")),
            F.when(b["table_count"] != a["table_count"], changed("Table count", "table_count")),
            F.when((b["word_count"] >= 60) & (words >= 0.4), changed("Word count", "word_count")),
        )
    )


def pair_versions(before: DataFrame, after: DataFrame, path: str = "path", text: str = "html") -> DataFrame:
    """Full outer join of two packages by path; a missing page is empty."""
    j = before.select(path, F.col(text).alias("original")).join(after.select(path, F.col(text).alias("converted")), path, "full_outer")
    return j.select(path, F.coalesce("original", F.lit("")).alias("original"), F.coalesce("converted", F.lit("")).alias("converted"))


def first_block(text: Column) -> Column:
    """The first block with text of a page's body."""
    blocks = F.transform(matches(text, r"(?is)<(?:p|h[1-6]|li|div|td)\b[^>]*>(.*?)</(?:p|h[1-6]|li|div|td)>", 1), lambda x: plain_text(x))
    return F.coalesce(F.get(F.filter(blocks, lambda b: b != ""), F.lit(0)), F.lit(""))


def title_repeated(text: Column) -> Column:
    """The title is the text of the first heading. Texts without a letter or digit that
    is compared (other alphabets) say nothing, so they repeat nothing."""
    title, head = compare_key(title_text(text)), F.coalesce(compare_key(F.get(headings(text), F.lit(0))), F.lit(""))
    return (title != "") & (title == head)


def visual_audit(pairs: DataFrame) -> DataFrame:
    o, c = F.col("original"), F.col("converted")
    # The audit compares keys of two texts that are there, also where both keys are empty.
    title, head = title_text(c), F.coalesce(F.get(headings(c), F.lit(0)), F.lit(""))
    icons = matches(c, r"""(?i)<img\b[^>]*src\s*=\s*["'][^"']*templateassets/[^"']+["'][^>]*>""")
    odd = F.filter(icons, lambda t: ~F.lower(t).rlike(r"banner-|footer\.png|course-card\.png|width: 24px|width: 45px|width: 72px"))
    return pairs.select(
        "path",
        (o != "").alias("original_exists"),
        (c != "").alias("converted_exists"),
        ((title != "") & (head != "") & (compare_key(title) == compare_key(head))).alias("duplicate_title_first_block"),
        count_of(o, r"""(?i)<div\b[^>]*class\s*=\s*["'][^"']*\bcard\b[^"']*["'][^>]*>""").alias("original_accordion_cards"),
        count_of(c, r"""(?i)<details\b[^>]*class\s*=\s*['"][^'"]*\bmigration-accordion\b[^'"]*['"][^>]*>""").alias("converted_details_blocks"),
        count_of(F.lower(c), "/shared/brightspace_html_template/").alias("converted_shared_template_refs"),
        count_of(c, r"(?i)<title\b").alias("converted_title_tags"),
        F.size(F.filter(matches(c, r"(?i)<hr\b[^>]*>"), lambda t: ~F.contains(F.lower(t), F.lit("height: 2px")))).cast("long").alias("converted_hr_nonstandard"),
        F.size(odd).cast("long").alias("converted_template_icons_missing_size_style"),
        count_of(o, r"(?i)<math\b").alias("original_mathml_count"),
        count_of(c, r"(?i)<math\b").alias("converted_mathml_count"),
        count_of(c, r"""(?i)<annotation\b[^>]*\bencoding\s*=\s*(["'])wiris\1""").alias("converted_wiris_annotation_count"),
    )


def visual_summary(rows: DataFrame) -> DataFrame:
    hit = lambda c: F.count(F.when(F.col(c) > 0, 1))
    return rows.agg(
        F.count("*").alias("files_scanned"),
        F.count(F.when(F.col("duplicate_title_first_block"), 1)).alias("files_with_duplicate_title_first_block"),
        hit("converted_shared_template_refs").alias("files_with_remaining_shared_template_refs"),
        hit("converted_title_tags").alias("files_with_remaining_title_tags"),
        hit("converted_hr_nonstandard").alias("files_with_nonstandard_hr"),
        hit("converted_template_icons_missing_size_style").alias("files_with_icon_size_anomalies"),
        F.sum("original_accordion_cards").alias("total_original_accordion_cards"),
        F.sum("converted_details_blocks").alias("total_converted_details_blocks"),
        F.sum("original_mathml_count").alias("total_original_mathml"),
        F.sum("converted_mathml_count").alias("total_converted_mathml"),
        F.sum("converted_wiris_annotation_count").alias("total_converted_wiris_annotations"),
    )


def visual_reasons(row: DataFrame | None = None) -> Column:
    c = F.col
    return F.array_compact(
        F.array(
            F.when(c("duplicate_title_first_block"), F.lit("Converted page still repeats the title in the first content block.")),
            F.when(c("converted_shared_template_refs") > 0, F.lit("Converted page still references shared Brightspace template assets.")),
            F.when(c("converted_title_tags") > 0, F.lit("Converted page still contains one or more <title> tags.")),
            F.when(c("converted_hr_nonstandard") > 0, F.lit("Converted page still contains nonstandard divider styling.")),
            F.when(c("converted_template_icons_missing_size_style") > 0, F.lit("Converted page still contains template icons without standard sizing.")),
        )
    )


_MATH = r"(?is)<math\b[^>]*>.*?</math>"
_EQUATION = r"""(?is)<img\b[^>]*\bclass\s*=\s*(["'])[^"']*\bequation_image\b[^"']*\1[^>]*>"""
#: Elements that show something in a formula.
_MATH_CONTENT = r"(?i)<(?:mi|mn|mo|mtext|ms|mglyph|mfrac|msqrt|mroot|msub|msup|msubsup|mover|munder|munderover|mfenced|menclose|mmultiscripts|mtable|mtr|mtd)\b"
#: What a page's formulas may need checked, and the count that tells.
MATH_FLAGS = [
    ("raw_tex_delimiters", "raw_tex_delimiter"), ("equation_images_missing_alt", "equation_images_missing_alt"), ("equation_images_missing_source", "equation_images_missing_source"),
    ("absolute_equation_image_urls", "absolute_equation_image_url"), ("empty_mathml_stubs", "empty_mathml_stub"),
]
MIXED_MATH = "mixed_math_modes"


def math_counts(text: Column) -> dict[str, Column]:
    """What a page holds of formulas, by name."""
    images = matches(text, _EQUATION)
    n = lambda keep: F.size(F.filter(images, keep)).cast("long")
    value = lambda tag, name: F.coalesce(decode_basic(attribute(tag, name)), F.lit(""))
    absolute = lambda t: F.lower(value(t, "src")).rlike("^https?://") & F.contains(F.lower(value(t, "src")), F.lit("/equation_images/"))
    block = r"(?is)<(p|div)\b([^>]*)>\s*((?:<span\b[^>]*>\s*)?<img\b[^>]*>(?:\s*</span>)?)\s*</\1>"
    alone = F.filter(matches(text, block), lambda x: ~F.contains(F.lower(F.regexp_extract(x, block, 2)), F.lit("migration-display-equation")) & F.regexp_extract(x, block, 3).rlike(_EQUATION))

    def empty(formula: Column) -> Column:
        bare = F.regexp_replace(formula, r"(?is)<annotation(?:-xml)?\b[^>]*>.*?</annotation(?:-xml)?>", "")
        return ~bare.rlike(_MATH_CONTENT) & (plain_text(bare) == "")

    return {
        "mathml": count_of(text, _MATH),
        "wiris_annotation": count_of(text, r"""(?is)<annotation\b[^>]*\bencoding\s*=\s*(["'])wiris\1[^>]*>.*?</annotation>"""),
        "equation_image": F.size(images).cast("long"),
        "raw_tex_delimiter": count_of(text, r"(?s)(?<!\\)\$\$.+?(?<!\\)\$\$") + count_of(text, r"(?s)\\\(.+?\\\)") + count_of(text, r"(?s)\\\[.+?\\\]"),
        "display_math_block": count_of(text, r"""(?is)<math\b[^>]*(?:\bdisplay\s*=\s*(["'])block\1|\bmode\s*=\s*(["'])display\2)[^>]*>.*?</math>""") + F.size(alone).cast("long"),
        "empty_mathml_stub": F.size(F.filter(matches(text, _MATH), empty)).cast("long"),
        "absolute_equation_image_url": n(absolute),
        "equation_images_missing_alt": n(lambda t: F.trim(value(t, "alt")) == ""),
        "equation_images_missing_source": n(lambda t: (value(t, "data-equation-content") == "") & (F.trim(value(t, "title")) == "")),
    }


def math_modes(counts: dict[str, Column]) -> Column:
    """The ways in which a page writes formulas."""
    return F.array_compact(F.array(*(F.when(counts[c] > 0, F.lit(m)) for m, c in (("mathml", "mathml"), ("equation_image", "equation_image"), ("raw_tex", "raw_tex_delimiter")))))


def math_audit(pairs: DataFrame) -> DataFrame:
    """Formulas of both versions of a page (path, original, converted), and what to
    check in the converted one."""
    o, c = math_counts(F.col("original")), math_counts(F.col("converted"))
    rows = pairs.select("path", o["mathml"].alias("original_mathml_count"), *(x.alias(f"converted_{k}_count") for k, x in c.items()), math_modes(o).alias("original_math_modes"), math_modes(c).alias("converted_math_modes"))
    flags = [F.when(F.col(f"converted_{k}_count") > 0, F.lit(f)) for f, k in MATH_FLAGS]
    return rows.withColumn("review_flags", F.array_compact(F.array(*flags, F.when(F.size("converted_math_modes") > 1, F.lit(MIXED_MATH)))))


def math_summary(rows: DataFrame) -> DataFrame:
    """Totals of :func:`math_audit` in one row."""
    c = lambda k: F.col(f"converted_{k}_count")
    n = lambda cond: F.count(F.when(cond, 1))
    total = lambda col, name: F.coalesce(F.sum(col), F.lit(0)).alias(name)
    #: Names of totals by count.
    names = {"mathml": "converted_mathml", "wiris_annotation": "converted_wiris_annotations", "equation_image": "converted_equation_images", "raw_tex_delimiter": "converted_raw_tex_delimiters", "display_math_block": "converted_display_math_blocks", "empty_mathml_stub": "converted_empty_mathml_stubs", "absolute_equation_image_url": "absolute_equation_image_urls", "equation_images_missing_alt": "equation_images_missing_alt", "equation_images_missing_source": "equation_images_missing_source"}
    return rows.agg(
        F.count("*").alias("files_scanned"),
        n((c("mathml") > 0) | (c("equation_image") > 0) | (c("raw_tex_delimiter") > 0)).alias("files_with_math"),
        n(F.size("review_flags") > 0).alias("files_with_math_review_flags"),
        n(F.array_contains("review_flags", MIXED_MATH)).alias("files_with_mixed_math_modes"),
        total(F.col("original_mathml_count"), "total_original_mathml"),
        *(total(c(k), f"total_{v}") for k, v in names.items()),
    )


def review_score(manual: Column, a11y: Column, visual: Column, structural: Column, similarity: Column) -> Column:
    close = F.when((similarity > 0) & (similarity < 0.55), 2).when((similarity > 0) & (similarity < 0.72), 1).otherwise(0)
    return manual * 4 + a11y * 3 + visual * 2 + structural + close


def review_priority(score: Column, manual: Column, a11y: Column) -> Column:
    return F.when((manual >= 4) | (a11y >= 3) | (score >= 10), "high").when((manual > 0) | (a11y > 0) | (score >= 4), "medium").otherwise("low")

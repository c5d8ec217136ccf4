"""What a template package prescribes, one row for each package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.html import decode_basic, headings, plain_text

#: What the path of each page holds, and the phrases of each fact.
PAGES = {
    "image_customizations": "template-image-customizations",
    "introduction_instructions": "template-introduction-and-instructions",
    "ic_template": "module-introduction-and-checklist",
    "learning_activities_template": "module-learning-activities-template",
    "lesson_template": "module-lesson-title-template",
    "review_template": "module-1-review",
    "home_page": "wiki_content/home-page.html",
    "home_page_bps": "wiki_content/home-page-bps.html",
    "home_page_lcs": "wiki_content/home-page-lcs.html",
    "home_page_stem": "wiki_content/home-page-stem.html",
    "syllabus_online": "wiki_content/syllabus-2.html",
    "syllabus_f2f": "wiki_content/syllabus-f2f.html",
    "about_instructor": "wiki_content/about-the-instructor.html",
    "policies_support": "wiki_content/policies-and-support.html",
}
HOME_LINKS = ["Syllabus", "Policies and Support", "Course Q&A", "AI Excellence Institute"]
HOME_VARIANTS = [("Health Sciences", "home_page"), ("Business & Public Services", "home_page_bps"), ("Liberal Arts, Communication & Social Sciences", "home_page_lcs"), ("STEM", "home_page_stem")]
TEXT_FACTS = {
    "start_here_replaces_course_overview_survey": ("introduction_instructions", ["replaces the course overview survey"]),
    "paste_without_formatting_guidance_present": ("lesson_template", ["paste without formatting", "paste text without formatting"]),
    "home_page_ai_notice_present": ("home_page", ["this course is open to ai usage"]),
    "home_page_ai_notice_conditional": ("home_page", ["if your course policy allows ai use"]),
    "syllabus_has_table_of_contents": ("syllabus_online", ["syllabus table of contents"]),
    "syllabus_has_return_to_toc_links": ("syllabus_online", ["return to table of contents"]),
    "syllabus_has_ai_disclosure_section": ("syllabus_online", ["use of artificial intelligence in creating this course"]),
    "about_instructor_belonging_language_present": ("about_instructor", ["sense of belonging"]),
}
CREDENTIALS = "course credentials"
CREDENTIALS_WARNING = "Template instructions still mention Course Credentials, but the current template shell does not include that page."
SHELLS = {"start_here_items": "start here", "instructor_module_items": "instructor module (do not publish)"}


def _text(page: Column) -> Column:
    return F.lower(plain_text(decode_basic(F.coalesce(page, F.lit("")))))


def _labels(page: Column, labels: list[str]) -> Column:
    t = _text(page)
    return F.array_compact(F.array(*(F.when(F.contains(t, F.lit(x.lower())), F.lit(x)) for x in labels)))


def template_standards(pages: DataFrame, children: DataFrame, package: str = "package") -> DataFrame:
    """Facts of each package from its HTML pages (package, path, html) and the titles of
    its modules' children (package, module, titles, ordinal). A page is the first by path
    that holds its key; missing pages are empty."""
    low, h = F.lower("path"), F.col("html")
    some = pages.where(F.endswith(low, F.lit(".html")))
    holds = lambda k: F.contains(low, F.lit(k))
    hit = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    own = some.groupBy(package).agg(
        *(F.min_by(F.when(holds(k), h), F.when(holds(k), F.col("path"))).alias(n) for n, k in PAGES.items()),
        hit(h.rlike(r"(?i)border-bottom:\s*10px\s+solid\s+#ac1a2f"), "primary_rule"),
        hit(h.rlike(r"(?i)border-top:\s*8px\s+solid\s+#ac1a2f"), "thick_rule"),
        hit(F.contains(F.lower(h), F.lit("<hr")), "any_rule"),
        hit(F.contains(_text(h), F.lit(CREDENTIALS)), "instructions_reference_course_credentials"),
        hit(F.contains(_text(h), F.lit("accordion")), "accordion_guidance_present"),
    )
    m = F.lower(F.trim("module"))
    none = F.array().cast("array<string>")
    first = lambda c: F.coalesce(F.min_by(F.when(c, F.col("titles")), F.when(c, F.col("ordinal"))), none)
    shell = children.groupBy(package).agg(
        *(F.coalesce(F.max_by(F.when(m == t, F.col("titles")), F.when(m == t, F.col("ordinal"))), none).alias(n) for n, t in SHELLS.items()),
        first(F.startswith(m, F.lit("module 1:"))).alias("lesson_module_items"),
        first(F.contains(m, F.lit("course conclusion"))).alias("course_conclusion_items"),
        hit(F.exists("titles", lambda t: F.lower(t) == CREDENTIALS), "course_credentials_in_shell"),
    )
    j = own.join(shell, package, "left")
    page = lambda n: F.coalesce(F.col(n), F.lit(""))
    image, home = page("image_customizations"), page("home_page")
    sections = lambda n: F.filter(headings(page(n)), lambda x: x != "")
    rule = lambda c, text: F.when(c, text).otherwise("")
    shown = F.coalesce("course_credentials_in_shell", F.lit(False))
    facts = {k: F.coalesce(*(F.when(F.contains(_text(page(n)), F.lit(p)), True) for p in ps), F.lit(False)) for k, (n, ps) in TEXT_FACTS.items()}
    variants = [F.when(_text(page(n)) != "", F.struct(F.lit(label).alias("division"), _labels(page(n), HOME_LINKS).alias("links"))) for label, n in HOME_VARIANTS]
    return j.select(
        package,
        *(sections(n).alias(c) for c, n in (("ic_sections", "ic_template"), ("learning_activities_sections", "learning_activities_template"), ("review_sections", "review_template"), ("lesson_sections", "lesson_template"))),
        F.when(image.rlike(r"(?i)\b45px\b"), 45).alias("heading_icon_width_px"),
        F.contains(F.lower(image), F.lit("decorative")).alias("decorative_icon_alt_expected"),
        F.lower(F.regexp_extract(image, r"(?i)\bac1a2f\b", 0)).alias("red_hex"),
        F.contains(F.lower(image), F.lit("two separate elements")).alias("icon_text_can_be_copied_separately"),
        rule(F.col("primary_rule"), "border-bottom: 10px solid #ac1a2f").alias("primary_page_heading_rule"),
        rule(F.col("thick_rule"), "border-top: 8px solid #ac1a2f").alias("thick_red_divider_rule"),
        rule(F.col("any_rule"), "unstyled <hr>").alias("internal_separator_rule"),
        rule(home.rlike(r"(?i)border-bottom:\s*2px\s+solid\s+#cccccc"), "border-bottom: 2px solid #cccccc").alias("home_page_section_rule"),
        rule(home.rlike(r"(?i)background:\s*#eeeeee"), "#eeeeee").alias("home_page_header_background"),
        *(F.coalesce(c, none).alias(c) for c in (*SHELLS, "lesson_module_items", "course_conclusion_items")),
        shown.alias("course_credentials_in_shell"),
        "instructions_reference_course_credentials",
        _text(page("learning_activities_template")).rlike("video title.*?transcript.*?timestamp.*?citation").alias("view_requires_video_title_transcript_timestamp_citation"),
        "accordion_guidance_present",
        *(c.alias(k) for k, c in facts.items()),
        _labels(home, HOME_LINKS).alias("home_page_links"),
        F.array_compact(F.array(F.when(_text(page("syllabus_online")) != "", F.lit("Online")), F.when(_text(page("syllabus_f2f")) != "", F.lit("Face-to-Face")))).alias("syllabus_variants_present"),
        (F.trim(page("policies_support")) != "").alias("policies_support_page_present"),
        F.array_compact(F.array(*variants)).alias("home_page_variants"),
        F.array_compact(F.array(F.when(F.col("instructions_reference_course_credentials") & ~shown, F.lit(CREDENTIALS_WARNING)))).alias("warnings"),
    )

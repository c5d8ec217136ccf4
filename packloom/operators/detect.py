"""Detectors: each is a column array<struct<reason, evidence>> over HTML text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packloom.functions.html import attribute, decode_basic, heading_levels, let, matches, plain_text, style_map

#: Link texts that say nothing, and domains of embedded tools.
VAGUE = ["click here", "here", "learn more", "more"]
TOOLS = [("panopto.com", "Panopto"), ("instructuremedia.com", "Canvas Studio"), ("studio.canvas.com", "Canvas Studio"), ("kaltura.com", "Kaltura"), ("yuja.com", "YuJa")]
WIDE_PX = 500


def issue(reason: str | Column, evidence: Column) -> Column:
    return F.struct((F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), evidence.alias("evidence"))


def image_issues(text: Column) -> Column:
    """Images without alt text; an empty one is right for presentational images."""
    tags = matches(text, r"(?i)<img\b[^>]*>")
    hidden = lambda t: t.rlike(r"""(?i)\brole\s*=\s*(["'])presentation\1|\baria-hidden\s*=\s*(["'])true\2""")

    def one(t: Column) -> Column:
        alt = attribute(t, "alt")
        return F.when(alt.isNull(), issue("Image missing alt attribute", F.left(t, F.lit(120)))).when((F.trim(alt) == "") & ~hidden(t), issue("Image alt attribute is empty", F.left(t, F.lit(120))))

    return F.array_compact(F.transform(tags, one))


def heading_jumps(text: Column) -> Column:
    """A level more than one below the heading before it."""
    levels = heading_levels(text)
    pairs = F.zip_with(levels, F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    jumps = F.filter(pairs, lambda p: p.b - p.a > 1)
    return F.transform(jumps, lambda p: issue("Heading level jump detected", F.concat(F.lit("h"), p.a, F.lit(" -> h"), p.b)))


def table_issues(text: Column) -> Column:
    tables = matches(text, r"(?is)<table\b.*?</table>")
    caption = lambda t: plain_text(F.regexp_extract(t, r"(?is)<caption\b[^>]*>(.*?)</caption>", 1))
    bare = F.filter(tables, lambda t: caption(t) == "")
    return F.transform(bare, lambda t: issue("Table missing caption", F.replace(F.left(t, F.lit(120)), F.lit("\n"), F.lit(" "))))


def link_issues(text: Column) -> Column:
    shown = F.transform(matches(text, r"(?is)<a\b[^>]*>(.*?)</a>", 1), lambda a: F.trim(F.regexp_replace(a, "<[^>]+>", "")))
    vague = F.filter(shown, lambda s: F.lower(s).isin(VAGUE))
    return F.transform(vague, lambda s: issue("Non-descriptive link text", F.left(s, F.lit(120))))


def accessibility(text: Column) -> Column:
    return F.concat(image_issues(text), heading_jumps(text), table_issues(text), link_issues(text))


def template_issues(text: Column, path: Column, notes: bool = True, placeholders: bool = True, quiz: bool = True, closer: bool = True) -> Column:
    """Placeholders that were never filled in, each kind behind its policy flag."""
    low = F.lower(decode_basic(text))
    found = []
    if notes:
        found.append(F.when(text.rlike(r"(?i)\[\s*instructor note\s*:"), issue("Instructor Note placeholder remains in content", F.lit("[Instructor Note: ...]"))))
    if placeholders:
        hit = F.coalesce(*(F.when(low.rlike(p), F.regexp_extract(low, p, 0)) for p in (r"\bfill in text here\b", r"\[title here\]", r"\bxx\b")))
        found.append(F.when(hit.isNotNull(), issue("Template placeholder text remains in content", hit)))
    if quiz:
        found.append(F.when(text.rlike(r'(?i)click\s+the\s+"?take\s+the\s+quiz"?\s+button'), issue('Legacy quiz instructions detected ("Take the Quiz")', F.lit('Click the "Take the Quiz" button'))))
    if closer:
        intro = F.contains(low, F.lit("introduction and checklist")) | F.contains(F.lower(path), F.lit("introduction-and-checklist"))
        ends = [F.lit("contact your instructor with any questions or post in the course q&a"), F.lit("contact your instructor with any course questions.")]
        lacking = intro & ~F.contains(low, ends[0]) & ~F.contains(low, ends[1])
        found.append(F.when(lacking, issue("Module Checklist closing reminder appears to be missing", F.lit("Contact your instructor with any questions or post in the Course Q&A."))))
    return F.array_compact(F.array(*found))


_STYLED = (
    r"(?is)<(?:div|span|section|article|aside|main|header|footer|nav|table|td|th|tr|caption|p|pre|blockquote|figure|figcaption"
    r"|ul|ol|li|dl|dt|dd|h[1-6]|a|button|details|summary)\b[^>]*\bstyle\s*=[^>]*>"
)


def layout_intent(tag: Column) -> Column:
    """struct of the layout patterns in a tag's inline style."""
    return let(style_map(F.coalesce(attribute(tag, "style"), F.lit(""))), _intent)


def _intent(m: Column) -> Column:
    get = lambda k: F.lower(F.coalesce(F.element_at(m, F.lit(k)), F.lit("")))
    px = F.regexp_extract(get("width"), r"^(\d+(?:\.\d+)?)px$", 1)
    wide = F.when(px != "", F.floor(px.try_cast("double")).cast("int"))
    over = lambda k: get(k).isin("hidden", "scroll", "auto")
    return F.struct(
        get("float").isin("left", "right").alias("has_float"),
        get("position").isin("absolute", "fixed").alias("has_absolute_position"),
        F.coalesce(wide > WIDE_PX, F.lit(False)).alias("has_fixed_width"),
        F.when(wide > WIDE_PX, wide).alias("fixed_width_px"),
        (over("overflow") | over("overflow-x") | over("overflow-y")).alias("has_overflow_control"),
        get("display").isin("flex", "inline-flex", "grid", "inline-grid").alias("has_flex_or_grid"),
        (F.map_contains_key(m, "column-count") | F.map_contains_key(m, "columns")).alias("has_multicolumn"),
        F.map_contains_key(m, "z-index").alias("has_z_index"),
    )


def is_breaking(i: Column) -> Column:
    return i.has_absolute_position | i.has_flex_or_grid | i.has_multicolumn


def is_notable(i: Column) -> Column:
    return is_breaking(i) | i.has_float | i.has_fixed_width | i.has_overflow_control | i.has_z_index


def layout_elements(text: Column) -> Column:
    """array<struct<tag, intent>> of notable elements; those that a rewrite put
    there (class ``migration-...``) are left out."""
    tags = F.filter(matches(text, _STYLED), lambda t: ~t.rlike(r"""(?i)\bclass\s*=\s*(["'])[^"']*migration-[^"']*\1"""))
    both = F.transform(tags, lambda t: F.struct(t.alias("tag"), layout_intent(t).alias("intent")))
    return F.filter(both, lambda x: is_notable(x.intent))


def tool_embeds(text: Column) -> Column:
    """One issue per embedded tool and page, for the first frame that shows it."""
    frames = matches(text, r"(?is)<iframe\b[^>]*>")
    src = lambda t: F.lower(F.coalesce(attribute(t, "src"), attribute(t, "data-mce-src"), F.lit("")))

    def tool(t: Column) -> Column:
        return F.coalesce(*(F.when(F.contains(src(t), F.lit(d)), F.lit(n)) for d, n in TOOLS))

    seen = F.filter(F.transform(frames, lambda t: F.struct(tool(t).alias("tool"), t.alias("tag"))), lambda x: x.tool.isNotNull())
    names = F.array_distinct(F.transform(seen, lambda x: x.tool))
    first = lambda n: F.element_at(F.filter(seen, lambda x: x.tool == n), 1).tag
    return F.transform(names, lambda n: issue(F.concat(F.lit("LTI tool embed ("), n, F.lit(") — verify launch URL after migration")), F.left(first(n), F.lit(240))))

"""Tables of a syllabus: what each is, its caption, its styles, and lists for those
that pair a label with a value."""

from __future__ import annotations

import html
import re

from packloom.rewrite.tags import Tag, each_tag, plain

# --- Fixed values: kinds of tables by what their text or summary says, captions,
# --- styles and classes. ---
#: Kind, phrases that the text must all hold, and a summary that tells as well.
KINDS = [
    ("course-outline", ["topics", "assignments", "due date"], ""),
    ("course-outline", ["16-week"], ""),
    ("course-outline", ["12-week"], ""),
    ("class-meeting-schedule", ["date", "time", "location or zoom link"], ""),
    ("assignment-weights", ["percent of total grade"], "grading policy"),
    ("grading-scale", ["grading scale"], "grading scale"),
    ("course-materials", ["course title:", "credit hours:"], ""),
    ("instructor-information", ["instructor:", "sinclair email:"], ""),
    ("office-hours", ["office hours"], ""),
]
CAPTIONS = {
    "course-outline": "Course Outline", "class-meeting-schedule": "Class Meeting Schedule", "assignment-weights": "Assignment Weights", "grading-scale": "Grading Scale",
    "course-materials": "Course Materials and Outcomes", "instructor-information": "Instructor Information", "office-hours": "Office Hours",
}
WEEKS = [("16-week", "Course Outline (16-Week)"), ("12-week", "Course Outline (12-Week)")]
WIDE = {"course-outline", "class-meeting-schedule"}
LISTED = {"course-materials", "instructor-information"}
TABLE_CLASSES = ["ic-Table", "ic-Table--hover-row", "ic-Table--striped"]
HEADER_STYLE = {"background-color": "#000000", "color": "#ffffff"}
LEAST_ITEMS = 3
# --- End of fixed values. ---


def kind_of(text: str, summary: str) -> str:
    """What a table is, by its text and its summary, both in lower case."""
    return next((k for k, phrases, told in KINDS if all(p in text for p in phrases) or (told and summary == told)), "")


def caption_of(kind: str, text: str, summary: str) -> str:
    if kind == "course-outline":
        return next((c for w, c in WEEKS if w in text), CAPTIONS[kind])
    return CAPTIONS.get(kind, summary)


def outer_tables(text: str) -> list[tuple[int, int]]:
    """Where tables that stand in no other one begin and end."""
    out, open_ = [], []
    for m in re.finditer(r"(?i)<(/?)table\b[^>]*>", text):
        if not m[1]:
            open_.append(m.start())
        elif open_:
            at = open_.pop()
            if not open_:
                out.append((at, m.end()))
    return out


def flat(cell: str) -> str:
    """A cell's content with the tables in it as lines."""
    if "<table" not in cell.lower():
        return cell.strip()
    cell = re.sub(r"(?i)</(?:td|th)>\s*<(?:td|th)\b[^>]*>", "<br>", cell)
    cell = re.sub(r"(?i)</tr>\s*<tr\b[^>]*>", "<br>", cell)
    cell = re.sub(r"(?i)</?(?:table|tbody|thead|tfoot|tr|td|th)\b[^>]*>", "", cell)
    return re.sub(r"(?i)(?:<br\s*/?>\s*){3,}", "<br><br>", cell).strip()


def as_list(inner: str, heading: str) -> str | None:
    """Rows of a label and a value as a list under a heading, if there are enough."""
    items = []
    for row in re.findall(r"(?is)<tr\b[^>]*>(.*?)</tr>", re.sub(r"(?is)<caption\b[^>]*>.*?</caption>", "", inner)):
        head, cell = (re.search(rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", row) for t in ("th", "td"))
        if not head or not cell:
            continue
        label, value = plain(head[1]).rstrip(":").strip(), flat(cell[1])
        shown = f"<strong>{html.escape(label, quote=False)}</strong>" if label else ""
        if not plain(value):
            items += [shown] if shown else []
        elif shown and re.search(r"(?i)<(?:div|p|ul|ol|h[1-6]|details|blockquote)\b", value):
            items.append(f"{shown}<div>{value}</div>")
        else:
            items.append(f"{shown}: {value}" if shown else value)
    if len(items) < LEAST_ITEMS:
        return None
    lines = "\n".join(f"<li>{x}</li>" for x in items)
    return f"<h3>{html.escape(heading, quote=False)}</h3>\n<ul>\n{lines}\n</ul>"


def _without_height(tag: Tag) -> bool:
    style = tag.style
    if "height" not in style:
        return False
    tag.put_style({k: v for k, v in style.items() if k != "height"})
    return True


def _cell(tag: Tag) -> int:
    changed = _without_height(tag)
    scope = (tag.get("scope") or "").strip().lower()
    if scope == "column":
        tag.set("scope", "col")
        changed, scope = True, "col"
    if scope == "col":
        changed |= tag.merge_style(HEADER_STYLE)
    return int(changed)


def one_table(text: str) -> tuple[str, int, str]:
    """A table in the template's form, how many tables changed, and the heading if it
    became a list."""
    opening = re.match(r"(?i)<table\b[^>]*>", text)
    closing = re.search(r"(?i)</table>\s*$", text)
    if not opening or not closing:
        return text, 0, ""
    inner, inside = tables(text[opening.end() : closing.start()])
    tag = Tag(opening[0])
    summary = (tag.get("summary") or "").strip()
    told = plain(inner).lower()
    kind = kind_of(told, summary.lower())
    old = re.search(r"(?is)<caption\b[^>]*>(.*?)</caption>", inner)
    caption = (plain(old[1]) if old else "") or caption_of(kind, told, summary)
    tag.drop("summary")
    _without_height(tag)
    wide = kind in WIDE or "coursetable" in (tag.get("class") or "").lower()
    tag.merge_style({"border-collapse": "collapse"} | ({"width": "100%"} if wide else {}))
    if kind in WIDE:
        more = [c for c in TABLE_CLASSES if c not in tag.classes]
        if more:
            tag.set("class", " ".join([*tag.classes, *more]))
        if tag.get("border") != "1":
            tag.set("border", "1")
    if caption:
        shown = html.escape(caption, quote=False)
        new = f"<caption><h3>{shown}</h3></caption>" if kind in WIDE else f"<caption>{shown}</caption>"
        inner = inner[: old.start()] + new + inner[old.end() :] if old else new + inner
    if kind in LISTED and caption:
        listed = as_list(inner, caption)
        if listed is not None:
            return listed, inside + 1, caption
    inner = each_tag(inner, "tr", lambda t: int(_without_height(t)))[0]
    inner = each_tag(inner, "th|td", _cell)[0]
    new = f"{tag.text}{inner}</table>"
    return new, inside + (new != text), ""


def tables(text: str) -> tuple[str, int]:
    """All tables of a page, tables in them first, and how many changed."""
    parts, last, total = [], 0, 0
    for start, end in outer_tables(text):
        before = text[last:start]
        new, n, heading = one_table(text[start:end])
        if heading:  # a heading "Section" before a list that has its own goes
            before = re.sub(r"(?is)<h3>\s*Section\s*</h3>\s*<div>\s*$", "<div>", before)
        parts += [before, new]
        total += n
        last = end
    return "".join([*parts, text[last:]]), total

"""Pages moved to a template: references to its assets, images, icon headings.

``overlay`` runs its steps over each page in one Arrow stage: references to the old
system's shared template become those of the new template's assets, images get sizes
that fit, headings and blocks that are nothing but an icon get its label, icon blocks
are merged with the text or heading that follows them, headings of level 4 with an icon
become a section's, and pages with introductions and learning activities get the
template's headings and lose the rule above them. What a template holds is
configuration, as many assets as its package has files; more than MAX_ASSETS assets or
aliases are refused.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from packloom.operators import overlay as rules
from packloom.rewrite import blocks
from packloom.rewrite.tags import Tag, each_tag, plain
from packloom.runtime import prepare

MAX_ASSETS = 100_000
FOLDER = "TemplateAssets"
# --- Fixed values: names, labels, styles and descriptions. ---
IGNORED = {
    "all.min.css", "bootstrap.min.css", "styles.min.css", "custom.css", "jquery-3.3.1.slim.min.js", "popper.min.js",
    "bootstrap.min.js", "scripts.min.js", "print.css", "print.js", "logo.png", "rule_brown_gradient.png",
}
NOT_ICONS = {"course-card.png", "footer.png", "instructor-photo.png", "instructor-resource-course.png", "student-resource-course.png", "video-placeholder.png"}
HEADING_ICON_STYLE = "width: 45px; height: auto; vertical-align: middle; margin-right: 8px;"
HEADING_COLOUR = ("color", "#ac1a2f")
PAGE_TITLE_STYLE = (HEADING_COLOUR, ("border-bottom", "10px solid #AC1A2F"), ("padding", "10px"))
SECTION_STYLE = (HEADING_COLOUR,)
INTRO_HEADINGS = {
    "introduction": ("star.png", "Introduction", PAGE_TITLE_STYLE),
    "learning objectives": ("bullseye.png", "Module Objectives", SECTION_STYLE),
    "module objectives": ("bullseye.png", "Module Objectives", SECTION_STYLE),
    "checklist": ("checkmark.png", "Module Checklist", SECTION_STYLE),
    "module checklist": ("checkmark.png", "Module Checklist", SECTION_STYLE),
}
INTRO_ICON, LEARNING_ICON = "star.png", "bookmark.png"
ICON_STYLE = {"width": "45px", "height": "auto", "vertical-align": "middle", "margin-right": "8px"}
FLOATING_ICON_STYLE = {"width": "45px", "max-width": "100%", "height": "auto"}
BANNER_STYLE = {"width": "100%", "height": "auto", "display": "block"}
BANNER_OLD = {"max-width", "min-width", "width", "height", "display"}
IMAGE_STYLE = {"max-width": "100%", "height": "auto", "display": "block", "margin": "20px auto", "clear": "both"}
IMAGE_OLD = {"width", "height", "max-width", "float", "display", "clear", "margin", "margin-left", "margin-right", "margin-top", "margin-bottom", "padding", "padding-left", "padding-right", "padding-top", "padding-bottom"}
WRAPPED = {"max-width": "45%", "height": "auto", "float": "{}", "display": "block", "clear": "none"}
WRAPPED_MARGIN = {"right": "4px 0 20px 24px", "left": "4px 24px 20px 0"}
BLOCK = {"max-width": "100%", "height": "auto", "display": "block", "clear": "both"}
BLOCK_MARGIN = {"right": "20px 0 20px auto", "left": "20px auto 20px 0"}
FLOAT_WIDTH, FLOAT_WIDTHS = 320, (240, 360)
DIRECT = "Mapped Brightspace template links to Canvas template assets (direct basename match)"
ALIAS = "Mapped Brightspace template links to Canvas template assets (alias map)"
ICONS = "Normalized mapped template icon image sizing for Canvas rendering"
BANNERS = "Normalized mapped template banner image sizing and decorative semantics for Canvas rendering"
ALTS = "Filled missing alt text for mapped template icon images"
TITLES = "Standardized mapped template icon title text using template glossary labels"
LABELS = "Added visible text labels next to icon-only headings using template glossary labels"
MERGED = "Merged standalone icon blocks into following headings for template-style icon+label layout"
PROMOTED = "Promoted template icon section headings to maintain Canvas-safe heading order"
HEADINGS = "Normalized page and section headings to match template heading styles"
DIVIDERS = "Removed redundant leading dividers ahead of template-styled page headings"
IMAGES = "Normalized content image spacing and responsive sizing for Canvas-safe layouts"
IMAGES_WRAPPED = "Preserved wrapped image layouts within Canvas-safe width limits"
UNMAPPED = "Template asset reference not mapped to Canvas template package"
ORDER = [DIRECT, ALIAS, ICONS, BANNERS, ALTS, TITLES, LABELS, MERGED, PROMOTED, HEADINGS, DIVIDERS, IMAGES, IMAGES_WRAPPED]
# --- End of fixed values. ---


@dataclass(frozen=True)
class Template:
    """How many files of a template have each name, names to try for others, and the
    labels of icons. All names are in lower case."""

    assets: dict[str, int]
    aliases: dict[str, list[str]] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    visual: bool = True
    colour: bool = True
    wrap_images: bool = False
    dividers: bool = True

    def names(self) -> set[str]:
        return set(self.assets) | set(self.aliases) | {t for ts in self.aliases.values() for t in ts} | set(self.labels)

    def find(self, name: str) -> tuple[str | None, str]:
        """The asset for a name, and how it was found."""
        n = self.assets.get(name, 0)
        if n:
            return (name, "direct") if n == 1 else (None, "collision")
        for other in self.aliases.get(name, ()):
            n = self.assets.get(other, 0)
            if n:
                return (other, "alias") if n == 1 else (None, "alias_collision")
        return None, "unmapped"


def load_template(assets: DataFrame, aliases: DataFrame, labels: dict[str, str] | DataFrame | None = None, **flags: bool) -> Template:
    """From tables of assets (name) and ordered aliases (source, pos, target). Labels are
    a table as :func:`packloom.operators.overlay.glossary` gives it, or names and labels
    beside the default ones."""
    if isinstance(labels, DataFrame):
        told = labels.limit(MAX_ASSETS + 1).collect()
        if len(told) > MAX_ASSETS:
            raise ValueError(f"a template of more than {MAX_ASSETS} labels")
        labels = {r["name"]: r["label"] for r in told}
    rows = assets.groupBy("name").count().limit(MAX_ASSETS + 1).collect()
    if len(rows) > MAX_ASSETS:
        raise ValueError(f"a template of more than {MAX_ASSETS} assets")
    n: Counter = Counter()
    for r in rows:
        n[r["name"].lower()] += r["count"]
    tries: dict[str, list[str]] = {}
    others = aliases.limit(MAX_ASSETS + 1).collect()
    if len(others) > MAX_ASSETS:
        raise ValueError(f"a template of more than {MAX_ASSETS} aliases")
    for r in sorted(others, key=lambda r: r["pos"]):
        tries.setdefault(r["source"].lower(), []).append(r["target"].lower())
    return Template(dict(n), tries, rules.DEFAULT_LABELS | (labels or {}), **flags)


def _path(url: str) -> str:
    """The decoded path of an address without query and fragment."""
    base = re.split("[#?]", html.unescape(url.strip()), maxsplit=1)[0]
    parts = urlsplit(base)
    return unquote(parts.path if parts.scheme or parts.netloc else base).strip()


def base_name(path: str) -> str:
    return path.strip().replace("\\", "/").rpartition("/")[2].strip().lower()


def heading_label(raw: str, icon: str) -> str:
    """:func:`packloom.operators.overlay.heading_label` of one label."""
    t = re.sub(r"\s+", " ", html.unescape(raw).strip())
    t = re.sub(r"(?i)\s+(?:or|and/or)\s+.*$", "", t)
    label = re.sub(r"(?i)\s+also represents.*$", "", t).strip(" -:;,.")
    key = compare(label)
    for i, keys, new in rules.LABELS_FIRST:
        if icon == i or key in keys:
            return new
    if icon == rules.VIEW_ICON and key in dict(rules.BOOKMARK_LABELS):
        return dict(rules.BOOKMARK_LABELS)[key]
    return next((new for i, keys, new in rules.LABELS if (i and icon == i) or key in keys), label)


def compare(text: str) -> str:
    return " ".join(re.sub("[^a-z0-9 ]+", "", plain(text).lower().replace("&", "and")).split())


def remap(text: str, t: Template, notes: Counter, lost: list[str], skipped: list[str]) -> str:
    """References to the shared template, and to standard images that have an alias."""

    def one(m: re.Match) -> str:
        url = m["url"].strip()
        path = _path(url)
        shared = path.lstrip("/").lower().startswith("shared/brightspace_html_template/")
        if not shared and "standardimages/" not in url.lower():
            return m[0]
        name = base_name(path)
        if not shared and name not in t.aliases:
            return m[0]
        target, how = t.find(name) if name else (None, "")
        if target is None:
            if name in IGNORED:
                skipped.append(name)
            elif shared:
                lost.append(url)
            return m[0]
        notes[DIRECT if how == "direct" else ALIAS] += 1
        parts = urlsplit(url)
        more = (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else "")
        return f"{m['head']}{m['quote']}{FOLDER}/{target}{more}{m['quote']}"

    return re.sub(r"(?i)(?P<head>\b(?:href|src)\s*=\s*)(?P<quote>[\"'])(?P<url>[^\"']+)(?P=quote)", one, text)


def _size(tag: Tag) -> int | None:
    """The width of an image in pixels, of two to four digits."""
    if re.fullmatch(r"\d{2,4}", tag.get("width") or ""):
        return int(tag.get("width"))
    m = re.match(r"(?i)(\d{2,4})px", tag.style.get("width", ""))
    return int(m[1]) if m else None


def _content_image(tag: Tag, t: Template, notes: Counter) -> int:
    style = tag.style
    side = style.get("float", "").lower()
    large = re.fullmatch(r"\s*(?:[2-9]\d{2,}|\d{4,})\s*", tag.get("width") or "") or re.match(r"(?:[2-9]\d{2,}|\d{4,})px", style.get("width", ""))
    if not large and side not in ("left", "right"):
        return 0
    before, width = tag.text, _size(tag)
    tag.drop("width"), tag.drop("height")
    kept = {k: v for k, v in style.items() if k not in IMAGE_OLD}
    if side in ("left", "right"):
        wide = max(FLOAT_WIDTHS[0], min(FLOAT_WIDTHS[1], width)) if width is not None else FLOAT_WIDTH
        base, margin = (WRAPPED, WRAPPED_MARGIN) if t.wrap_images else (BLOCK, BLOCK_MARGIN)
        kept |= {"width": f"{wide}px"} | {k: v.format(side) for k, v in base.items()} | {"margin": margin[side]}
    else:
        kept |= IMAGE_STYLE
    tag.put_style(kept)
    if tag.text != before:
        notes[IMAGES_WRAPPED if t.wrap_images else IMAGES] += 1
    return tag.text != before


def _banner(tag: Tag, notes: Counter) -> int:
    before = tag.text
    tag.drop("width"), tag.drop("height")
    tag.put_style({k: v for k, v in tag.style.items() if k not in BANNER_OLD} | BANNER_STYLE)
    tag.set("alt", ""), tag.set("role", "presentation")
    notes[BANNERS] += tag.text != before
    return tag.text != before


def _icon(tag: Tag, notes: Counter) -> int:
    before = tag.text
    tag.drop("width"), tag.drop("height")
    style = tag.style
    floats = "float" in style
    if not floats:
        style = {k: v for k, v in style.items() if k != "max-width" and not (k == "height" and v.lower() == "auto")}
    tag.put_style(style | {k: v for k, v in (FLOATING_ICON_STYLE if floats else ICON_STYLE).items() if k not in style})
    notes[ICONS] += tag.text != before
    if tag.get("alt") != "":
        notes[ALTS] += 1
        tag.set("alt", "")
    notes[TITLES] += tag.drop("title")
    if (tag.get("role") or "").strip().lower() != "presentation":
        notes[ICONS] += 1
        tag.set("role", "presentation")
    return tag.text != before


def images(text: str, t: Template, notes: Counter) -> str:
    known = t.names()

    def edit(tag: Tag) -> int:
        src = (tag.get("src") or "").strip()
        name = base_name(unquote(urlsplit(src).path))
        if not name:
            return 0
        if "templateassets/" not in src.lower() and name not in known:
            return _content_image(tag, t, notes)
        if name.startswith("banner"):
            return _banner(tag, notes)
        return 0 if name in NOT_ICONS else _icon(tag, notes)

    return each_tag(text, "img", edit)[0]


def is_learning_page(path: str) -> bool:
    return bool(re.search(r"(?:^|/)learning activities(?:\s*-\s*[^/]+)?\.html$", path.replace("\\", "/").lower()))


def semantic_icon(current: str, label: str, title: str) -> str:
    """:func:`packloom.operators.overlay.semantic_icon` of one icon."""
    told = compare(" ".join(x for x in (label, title) if x))
    if not (label or title).strip():
        return current
    for phrases, icon in rules.ICONS:
        if any(p in told for p in phrases):
            return icon
    if current in rules.VIEW_ICONS or compare(label) in rules.VIEW_KEYS:
        return rules.VIEW_ICON
    return dict(rules.REPLACED_ICONS).get(current, current)


def icon_tag(name: str) -> str:
    return f'<img src="{FOLDER}/{name}" role="presentation" alt="" style="{HEADING_ICON_STYLE}">'


def icon_of(tag: str) -> str:
    return base_name(unquote(urlsplit(Tag(tag).get("src") or "").path))


def coloured(attrs: str, t: Template) -> str:
    """A heading's attributes with the template's colour, unless it has one."""
    tag = Tag(f"<h{attrs}>")
    if t.colour and HEADING_COLOUR[0] not in tag.style:
        tag.put_style(tag.style | dict([HEADING_COLOUR]))
    return tag.text[2:-1]


def icon_headings(text: str, path: str, t: Template, notes: Counter) -> str:
    """Headings and blocks that hold an icon alone get its label."""
    fixed = 2 if is_learning_page(path) else 0

    def labelled(m: re.Match, level: int, attrs: str) -> str:
        name = icon_of(m["img"])
        label = heading_label(t.labels.get(name, ""), name) if name else ""
        if not label:
            return m[0]
        new = f"<h{level}{attrs}>{icon_tag(name)} <strong>{html.escape(label)}</strong></h{level}>"
        notes[LABELS] += new != m[0]
        return new

    def heading(m: re.Match) -> str:
        return labelled(m, fixed or int(m["level"]), coloured(m["attrs"], t))

    def block(m: re.Match) -> str:
        return labelled(m, fixed or 3, f' style="{HEADING_COLOUR[0]}: {HEADING_COLOUR[1]};"' if t.colour else "")

    text = re.sub(r"(?is)<h(?P<level>[1-6])(?P<attrs>[^>]*)>\s*(?P<img><img\b[^>]*>)\s*</h(?P=level)>", heading, text)
    return re.sub(r"(?is)<(?P<wrapper>p|div)\b[^>]*>\s*(?P<img><img\b[^>]*templateassets/[^>]+>)\s*</(?P=wrapper)>", block, text)


def _styles(attrs: str, wanted: tuple[tuple[str, str], ...], t: Template) -> str:
    """Attributes with a heading's styles, as far as the template's flags want them."""
    off = {k for k, on in (("color", t.colour), ("border-bottom", t.dividers)) if not on}
    return blocks.restyled(attrs, tuple(w for w in wanted if w[0] not in off), {"color", "border-bottom", "padding"} - off)


def merge_blocks(text: str, path: str, t: Template, notes: Counter) -> str:
    """Icon blocks merged with what follows, and promoted headings."""
    learning = is_learning_page(path)
    p = blocks.Passes(label=heading_label, icon=semantic_icon, image=icon_tag, coloured=lambda a: coloured(a, t), known=t.labels, section=lambda n: 2 if learning else n, name=icon_of)
    for step in (p.with_label, p.with_boxed_heading, p.with_heading):
        text = blocks.edited(text, lambda s, i, step=step: step(s, i, compare))
    text = blocks.edited(text, p.promote)
    notes[MERGED] += p.count["merged"]
    notes[PROMOTED] += p.count["promoted"]
    return text


def page_headings(text: str, path: str, t: Template, notes: Counter) -> str:
    """The template's headings on pages with introductions and learning activities."""
    name = path.replace("\\", "/").lower()
    seen: set[str] = set()

    def intro(s: blocks.Stream, i: int):
        last = s.heading(i)
        if last is None:
            return None
        body = s.body(i, last)
        key = compare(body)
        if key not in INTRO_HEADINGS or key in seen:
            return last, None
        seen.add(key)
        icon, label, style = INTRO_HEADINGS[key]
        new = f"<h2{_styles(s.attrs(i), style, t)}>{icon_tag(icon)} <strong>{label}</strong></h2>"
        new += "".join(f"\n<p>{m}</p>" for m in blocks.title_and_media(body)[1])
        notes[HEADINGS] += new != s.text[s.start[i] : s.end[last]]
        return last, new

    def learning(s: blocks.Stream, i: int):
        last = None if seen else s.heading(i)
        if last is None:
            return None
        seen.add("")
        body = s.body(i, last)
        title = plain(body)
        if "templateassets/" in body.lower() or not title:
            return last, None
        new = f"<h2{_styles(s.attrs(i), PAGE_TITLE_STYLE, t)}><strong>{icon_tag(LEARNING_ICON)} {html.escape(title)}</strong></h2>"
        notes[HEADINGS] += new != s.text[s.start[i] : s.end[last]]
        return last, new

    for step, here, icon in ((intro, name.endswith("introduction and objectives.html"), INTRO_ICON), (learning, is_learning_page(path), LEARNING_ICON)):
        if here:
            text = blocks.edited(text, step)
            if t.dividers:
                text, gone = blocks.without_divider(text, icon)
                notes[DIVIDERS] += gone
    return text


def run(text: str, path: str, t: Template) -> tuple[str, list[tuple[str, int]], str | None, list[int]]:
    """The page, its changes, the first reference that has no asset, and how many
    were mapped directly, by alias, not at all, and are ignored."""
    notes: Counter = Counter()
    lost: list[str] = []
    skipped: list[str] = []
    text = remap(text, t, notes, lost, skipped)
    if t.visual:
        text = images(text, t, notes)
        text = icon_headings(text, path, t, notes)
        text = merge_blocks(text, path, t, notes)
        text = page_headings(text, path, t, notes)
    changes = [(d, notes[d]) for d in ORDER if notes[d]]
    return text, changes, lost[0][:120] if lost else None, [notes[DIRECT], notes[ALIAS], len(lost), len(skipped)]


def overlay(df: DataFrame, template: Template, path: str = "path", text: str = "html") -> DataFrame:
    """``df`` with its pages rewritten, and ``changes`` array<struct<description, count>>,
    ``unmapped`` (evidence of the finding UNMAPPED, or null), mapped_direct,
    mapped_alias, unresolved and ignored. A null page stays null."""
    names = df.columns
    sent = df.sparkSession.sparkContext.broadcast(template)
    kind = pa.list_(pa.struct([("description", pa.string()), ("count", pa.int64())]))
    at, where = names.index(text), names.index(path)
    counts = ["mapped_direct", "mapped_alias", "unresolved", "ignored"]

    def work(batches):
        t = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = [(None, [], None, [0] * 4) if x is None else run(x, p or "", t) for x, p in zip(part.column(at).to_pylist(), part.column(where).to_pylist())]
                cols = list(part.columns)
                cols[at] = pa.array([r[0] for r in rows], pa.string())
                changes = [[{"description": d, "count": n} for d, n in r[1]] for r in rows]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(changes, kind), pa.array([r[2] for r in rows], pa.string()), *(pa.array([r[3][k] for r in rows], pa.int64()) for k in range(4))], names=[*names, "changes", "unmapped", *counts])

    prepare(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(work, f"{schema}, changes array<struct<description:string,count:bigint>>, unmapped string, " + ", ".join(f"{c} long" for c in counts))

"""Blocks of a page as a stream of tags, and passes that look at what stands next.

``Stream`` cuts a page into tags and what is between them, and knows where the next
closing tag of a name is, so looking ahead costs no scan. A pass goes over it once, asks
what begins at a tag (an icon block, an empty block, a heading, a run of closing tags) and
writes its edits by offset; the page is put together once a pass. Where a pass leaves a
match as it is, it goes on behind it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

from packloom.rewrite.tags import plain

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>")
_VOID = re.compile(r"(?:\s|&nbsp;)*\Z", re.I)
_ICON = re.compile(r"""(?i)\bsrc\s*=\s*["'][^"']*templateassets/[^"']+["']""")
INLINE = {"span", "strong", "em", "b"}
HEADINGS = {f"h{i}" for i in range(1, 7)}
BOXES = {"p", "div"}
#: Closing tags of boxes that may stand between a block and what belongs to it.
CLOSERS = 4


class Stream:
    """Tags of a page: name (``/p`` where it closes), start and end."""

    def __init__(self, text: str):
        self.text = text
        self.name: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.closing: dict[str, list[int]] = {}
        for m in _TAG.finditer(text):
            if m[1]:
                self.closing.setdefault(m[2].lower(), []).append(len(self.name))
            self.name.append(m[1] + m[2].lower())
            self.start.append(m.start())
            self.end.append(m.end())

    def __len__(self) -> int:
        return len(self.name)

    def is_(self, i: int, names: set[str]) -> bool:
        return i < len(self) and self.name[i] in names

    def close(self, i: int) -> int | None:
        """The first closing tag of the name of tag ``i`` behind it."""
        at = self.closing.get(self.name[i], [])
        k = bisect_left(at, i + 1)
        return at[k] if k < len(at) else None

    def gap(self, i: int, entities: bool = False) -> bool:
        """Whether nothing but white space (and &nbsp;) is between tag ``i`` and the next."""
        between = self.text[self.end[i] : self.start[i + 1] if i + 1 < len(self) else len(self.text)]
        return bool(_VOID.match(between)) if entities else not between.strip()

    def body(self, i: int, j: int) -> str:
        return self.text[self.end[i] : self.start[j]]

    def tag(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]

    def attrs(self, i: int) -> str:
        """What follows the name of tag ``i``."""
        return self.text[self.start[i] + 1 + len(self.name[i]) : self.end[i] - 1]

    def inline(self, i: int) -> int:
        """The first tag from ``i`` on that is no inline mark, if only space is between."""
        while self.is_(i, INLINE) or i < len(self) and self.name[i][1:] in INLINE and self.name[i][0] == "/":
            if not self.gap(i, True):
                break
            i += 1
        return i

    def icon_block(self, i: int) -> tuple[int, int] | None:
        """The icon and the closing tag of a box with one template icon and nothing else."""
        if not self.is_(i, BOXES) or not self.gap(i, True):
            return None
        k = self.inline(i + 1)
        if not self.is_(k, {"img"}) or not _ICON.search(self.tag(k)) or not self.gap(k, True):
            return None
        end = self.inline(k + 1)
        return (k, end) if self.is_(end, {f"/{self.name[i]}"}) else None

    def empty(self, i: int, names: set[str], marks: bool = True) -> int | None:
        """The tag behind an empty element of ``names`` at ``i``: only space, and inline
        marks if ``marks``, up to a closing tag of one of the names."""
        if not self.is_(i, names) or not self.gap(i, marks):
            return None
        k = self.inline(i + 1) if marks else i + 1
        return k + 1 if self.is_(k, {f"/{n}" for n in names}) and self.gap(k) else None

    def skip(self, i: int, names: set[str], marks: bool = True) -> int:
        while (k := self.empty(i, names, marks)) is not None:
            i = k
        return i

    def closers(self, i: int, most: int = CLOSERS) -> int:
        while most and self.is_(i, {"/div"}) and self.gap(i):
            i, most = i + 1, most - 1
        return i

    def heading(self, i: int) -> int | None:
        """The closing tag of a heading at ``i``."""
        return self.close(i) if self.is_(i, HEADINGS) else None


def edited(text: str, edit: Callable[[Stream, int], tuple[int, str | None] | None]) -> str:
    """``text`` after ``edit`` was asked at each tag: None where nothing begins, else the
    last tag of what was found and its new text, or None to leave it."""
    s = Stream(text)
    out, done, i = [], 0, 0
    while i < len(s):
        got = edit(s, i)
        if got is None:
            i += 1
            continue
        last, new = got
        if new is not None:
            out += [text[done : s.start[i]], new]
            done = s.end[last]
        i = last + 1
    return "".join([*out, text[done:]])


def title_and_media(body: str) -> tuple[str, list[str]]:
    """The words of a heading, and its images that are not the template's."""
    media = [m for m in re.findall(r"(?i)<img\b[^>]*>", body) if "templateassets/" not in m.lower()]
    return plain(re.sub(r"(?i)&nbsp;", " ", body)), media


def restyled(attrs: str, wanted: tuple[tuple[str, str], ...], without: set[str]) -> str:
    """Attributes whose style lacks the keys ``without`` and ends with ``wanted``. Of
    a key that comes twice the first value stays."""
    m = re.search(r"(?i)(?<=\s)style\s*=\s*([\"'])([^\"']*)\1", attrs)
    style: dict[str, str] = {}
    for part in (m[2] if m else "").split(";"):
        key, colon, _ = part.partition(":")
        key = key.strip().lower()
        if colon and key not in without and key not in dict(wanted):
            style.setdefault(key, part.strip())
    style |= {k: f"{k}: {v}" for k, v in wanted}
    new = "".join(f"{v}; " for v in style.values()).rstrip()
    if m:
        return attrs[: m.start(2)] + new + attrs[m.end(2) :]
    return f'{attrs} style="{new}"' if new else attrs


class Passes:
    """What to make of icon blocks, headings and dividers on one page.

    ``label`` gives a heading's label of an icon and words, ``icon`` the icon that words
    call for, ``image`` an icon's tag, ``coloured`` a heading's attributes; ``known`` are
    the labels of icons, ``section`` the level of a section's heading for its own.
    """

    def __init__(self, *, label, icon, image, coloured, known: dict[str, str], section: Callable[[int], int], name: Callable[[str], str]):
        self.label, self.icon, self.image, self.coloured = label, icon, image, coloured
        self.known, self.section, self.name = known, section, name
        self.count: Counter = Counter()

    def render(self, level: int, attrs: str, icon: str, label: str, title: str, media: list[str], compare) -> str:
        """A heading with icon and label, then the title where its words are others, then
        the images."""
        out = f"<h{level}{attrs}>{self.image(icon)} <strong>{html.escape(label)}</strong></h{level}>"
        if compare(title) and compare(label) and compare(title) != compare(label):
            lower = min(level + 1, 6)
            out += f"\n<h{lower}>{html.escape(title)}</h{lower}>"
        return out + "".join(f"\n<p>{m}</p>" for m in media)

    def with_label(self, s: Stream, i: int, compare):
        """An icon block and the box behind it with a short text: a section's heading."""
        found = s.icon_block(i)
        if found is None or not s.gap(found[1]) or not s.is_(found[1] + 1, BOXES):
            return None
        first = found[1] + 1
        last = s.close(first)
        if last is None:
            return None
        body = s.body(first, last).strip()
        if not body or any(s.name[k] in HEADINGS | {"a", "iframe", "ul", "ol", "table", "details"} for k in range(first + 1, last)):
            return last, None
        title, media = title_and_media(body)
        if not title or len(title) > 100 or len(title.split()) > 12:
            return last, None
        icon = self.icon(self.name(s.tag(found[0])), title, title)
        self.count["merged"] += 1
        return last, self.render(self.section(3), self.coloured(""), icon, self.label(self.known.get(icon) or title, icon), title, media, compare)

    def _heading(self, s: Stream, image: int, at: int, last: int, compare) -> str | None:
        body = s.body(at, last).strip()
        title, media = title_and_media(body)
        if not title:
            return None
        now = self.name(s.tag(image))
        icon = self.icon(now, self.known.get(now, ""), title)
        self.count["merged"] += 1
        return self.render(self.section(int(s.name[at][1])), self.coloured(s.attrs(at)), icon, self.label(self.known.get(icon) or title, icon), title, media, compare)

    def _to_heading(self, s: Stream, i: int) -> tuple[int, int] | None:
        """The icon of an icon block, and the tag behind it and empty paragraphs."""
        found = s.icon_block(i)
        if found is None or not s.gap(found[1]):
            return None
        return found[0], s.skip(s.closers(found[1] + 1), {"p"})

    def with_boxed_heading(self, s: Stream, i: int, compare):
        """An icon block and a heading in a box of its own, empty blocks between."""
        found = self._to_heading(s, i)
        if found is None:
            return None
        k = s.skip(s.skip(found[1], HEADINGS), BOXES, False)
        if not s.is_(k, {"div"}) or not s.gap(k):
            return None
        k += 1
        while s.is_(k, {"br"}) and s.gap(k):
            k += 1
        last = s.heading(k)
        if last is None or not s.gap(last) or not s.is_(last + 1, {"/div"}):
            return None
        return last + 1, self._heading(s, found[0], k, last, compare)

    def with_heading(self, s: Stream, i: int, compare):
        """An icon block and a heading, empty paragraphs between."""
        found = self._to_heading(s, i)
        last = s.heading(found[1]) if found else None
        return None if last is None else (last, self._heading(s, found[0], found[1], last, compare))

    def promote(self, s: Stream, i: int):
        """Headings of level 4 with a template icon are a section's."""
        last = s.heading(i)
        if last is None:
            return None
        body = s.body(i, last)
        if s.name[i] != "h4" or "templateassets/" not in body.lower():
            return last, None
        self.count["promoted"] += 1
        level = self.section(3)
        return last, f"<h{level}{self.coloured(s.attrs(i))}>{body}</h{level}>"


def without_divider(text: str, icon: str) -> tuple[str, bool]:
    """A page without the rule at its top, if the heading behind it is of level 2 and an
    icon of the given name follows. Up to four boxes may open before the rule and one
    empty paragraph stand there; closing tags of boxes behind it go with it."""
    s = Stream(text)
    body = next((i for i, n in enumerate(s.name) if n == "body"), None)
    if body is None or not s.gap(body):
        return text, False

    def opened(k: int) -> int:
        for _ in range(CLOSERS):
            if not s.is_(k, {"div"}) or not s.gap(k):
                break
            k += 1
        return k

    k = opened(body + 1)
    if s.is_(k, {"p"}) and not s.is_(k + 1, {"hr"}):
        after = s.empty(k, {"p"})
        if after is None:
            return text, False
        k = after
    if not s.is_(k, {"hr"}) or not s.gap(k):
        return text, False
    behind = s.closers(k + 1)
    h = opened(behind)
    if not s.is_(h, {"h2"}) or f"templateassets/{icon}" not in text[s.end[h] :].lower():
        return text, False
    return text[: s.start[k]] + text[s.start[behind] :], True

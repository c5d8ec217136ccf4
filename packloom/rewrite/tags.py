"""Opening tags as editable values: edits touch only the attribute they concern."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

_ATTR = re.compile(r"""\s+([^\s=>/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.S)
_HEAD = re.compile(r"<([a-zA-Z][\w-]*)")


class Tag:
    """An opening tag. ``text`` is rendered again only from pieces that changed."""

    def __init__(self, text: str):
        self.text = text

    @property
    def name(self) -> str:
        return _HEAD.match(self.text)[1].lower()

    def _find(self, name: str) -> re.Match | None:
        if name not in self.text.lower():
            return None
        head = _HEAD.match(self.text).end()
        return next((m for m in _ATTR.finditer(self.text, head) if m[1].lower() == name and m[2] is not None), None)

    def get(self, name: str) -> str | None:
        m = self._find(name)
        if m is None:
            return None
        v = m[2]
        return html.unescape(v[1:-1] if v[0] in "\"'" else v)

    def set(self, name: str, value: str) -> None:
        quoted = f'"{html.escape(value, quote=True)}"'
        m = self._find(name)
        if m:
            self.text = self.text[: m.start(2)] + quoted + self.text[m.end(2) :]
        else:
            close = "/>" if self.text.endswith("/>") else ">"
            body = self.text[: -len(close)].rstrip()
            self.text = f"{body} {name}={quoted}{' ' if close == '/>' else ''}{close}"

    def drop(self, name: str) -> bool:
        m = self._find(name)
        if m:
            self.text = self.text[: m.start()] + self.text[m.end() :]
        return m is not None

    @property
    def style(self) -> dict[str, str]:
        return parse_style(self.get("style") or "")

    def put_style(self, style: dict[str, str]) -> None:
        if style:
            self.set("style", render_style(style))
        else:
            self.drop("style")

    def merge_style(self, new: dict[str, str]) -> bool:
        old = self.style
        both = old | new
        if both != old:
            self.put_style(both)
        return both != old

    @property
    def classes(self) -> list[str]:
        return (self.get("class") or "").split()


def parse_style(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for part in text.split(";"):
        k, colon, v = part.partition(":")
        if colon and k.strip() and v.strip():
            out[k.strip().lower()] = v.strip()
    return out


def render_style(style: dict[str, str]) -> str:
    return "; ".join(f"{k}: {v}" for k, v in style.items()) + ";" if style else ""


def each_tag(text: str, names: str, edit: Callable[[Tag], int | str | None]) -> tuple[str, int]:
    """Run ``edit`` on every opening tag whose name matches ``names``. It returns
    how much it changed, or a string that takes the tag's place (counted as 1)."""
    total = 0

    def one(m: re.Match) -> str:
        nonlocal total
        tag = Tag(m[0])
        got = edit(tag)
        if isinstance(got, str):
            total += 1
            return got
        total += got or 0
        return tag.text if got else m[0]

    return re.sub(rf"(?i)<(?:{names})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", one, text), total


def find_close(text: str, name: str, start: int) -> int:
    """End of the element that opens before ``start``: a scan that counts opening
    and closing tags of its name. -1 if it never closes."""
    depth = 1
    for m in re.finditer(rf"(?i)<(/?){name}\b[^>]*?(/?)>", text[start:]):
        depth += -1 if m[1] else (0 if m[2] else 1)
        if depth == 0:
            return start + m.end()
    return -1


def plain(text: str) -> str:
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", text))).strip()

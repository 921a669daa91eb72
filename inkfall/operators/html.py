"""A small tree of HTML elements on the standard parser: open tags nest until they are closed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not text of the document.
SILENT = frozenset(("script", "style", "template"))
#: The attributes of all elements without any; a long table has many.
_NO_ATTRS: dict[str, str] = {}


class Element:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]) -> None:
        self.name, self.attrs = name, attrs
        self.children: list[Element | str] = []

    def walk(self, *names: str) -> Iterator[Element]:
        """Elements of these names below this one, in the order of the document."""
        stack = list(reversed(self.children))
        while stack:
            child = stack.pop()
            if isinstance(child, Element):
                if child.name in names:
                    yield child
                stack.extend(reversed(child.children))

    def first(self, name: str) -> Element | None:
        return next(self.walk(name), None)

    def strings(self) -> Iterator[str]:
        stack: list[Element | str] = [self]
        while stack:
            child = stack.pop()
            if isinstance(child, str):
                yield child
            elif child is self or child.name not in SILENT:
                stack.extend(reversed(child.children))

    def words(self) -> str:
        """All strings without the space around them, one space between."""
        return " ".join(s for part in self.strings() if (s := part.strip()))

    def span(self, kind: str) -> int:
        return int(self.attrs.get(kind, 1))

    def shape(self) -> tuple:
        """Texts and names right below: what same() of equal elements begins with, sooner told."""
        return tuple(c if isinstance(c, str) else c.name for c in self.children)

    def same(self) -> tuple:
        """What two elements with equal names, attributes and content share."""
        told: list = []
        stack: list = [self]
        while stack:
            part = stack.pop()
            if isinstance(part, Element):
                told.append((part.name, tuple(sorted(part.attrs.items())), len(part.children)))
                stack.extend(reversed(part.children))
            else:
                told.append(part)
        return tuple(told)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines are not counted, as nothing asks for places

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        element = Element(tag, {k: v or "" for k, v in reversed(attrs)} if attrs else _NO_ATTRS)
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(text: str) -> Element:
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root


def cell_text(cell: Element) -> str:
    """A cell's text: images by their address, line breaks as commas, a space after paragraphs."""
    told: list[str] = []
    stack = list(reversed(cell.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            told.append(child)
        elif child.name == "img" and child.attrs.get("src"):
            alt, src = child.attrs.get("alt"), child.attrs["src"]
            told.append(f"[图片: {alt}({src})]" if alt else f"[图片: {src}]")
        elif child.name == "br":
            told.append("，")
        elif child.name not in SILENT:
            if child.name == "p":
                stack.append(" ")
            stack.extend(reversed(child.children))
    return re.sub(r"\s+", " ", "".join(told).strip())

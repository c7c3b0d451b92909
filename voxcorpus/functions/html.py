"""HTML pages and files to text: the one thing built-in functions cannot do, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxcorpus.functions import lists as L

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_JUNK = re.compile("|".join(L.JUNK_NAMES), re.I)


class Element:
    __slots__ = ("tag", "attrs", "inside")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.inside = tag, attrs, []

    def elements(self):
        """All elements below, in order."""
        stack = [iter(self.inside)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Element):
                    yield x
                    stack.append(iter(x.inside))
                    break
            else:
                stack.pop()

    def find(self, tag: str) -> Element | None:
        return next((e for e in self.elements() if e.tag == tag), None)

    def strings(self):
        stack = [iter(self.inside)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Element):
                    stack.append(iter(x.inside))
                    break
                yield x
            else:
                stack.pop()

    def text(self, separator: str = " ") -> str:
        return separator.join(s.strip() for s in self.strings() if s.strip())

    def without(self, drop) -> None:
        """Removes all elements below that ``drop`` is true of."""
        stack = [self]
        while stack:
            e = stack.pop()
            e.inside = [x for x in e.inside if not (isinstance(x, Element) and drop(x))]
            stack.extend(x for x in e.inside if isinstance(x, Element))


class _Tree(HTMLParser):
    """Open tags stay open until their end tag or that of an element around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inside.append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].inside.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].inside.append(data)


def parse(html: str | None) -> Element:
    tree = _Tree()
    try:
        tree.feed(html or "")
        tree.close()
    except (AssertionError, ValueError):
        pass
    return tree.root


def is_trail(text: str) -> bool:
    for s in L.TRAIL_SEPARATORS:
        pieces = text.split(s)
        if len(pieces) > 2:
            shown = [p.strip() for p in pieces if p.strip()]
            if shown and max(map(len, shown)) < 60:
                return True
    return False


def is_junk_block(block: Element) -> bool:
    """Empty, mostly links, many links in little text, or a trail."""
    text = block.text()
    links = [e.text() for e in block.elements() if e.tag == "a"]
    return (
        not text
        or sum(map(len, links)) > 0.5 * len(text) and len(text) < 300
        or len(links) > 5 and len(text) < 150
        or is_trail(text)
    )


def squeeze_paragraphs(text: str) -> str:
    paragraphs = (" ".join(p.split()) for p in re.split(r"\n\s*\n", text))
    return "\n\n".join(p for p in paragraphs if p)


def page_content(html: str | None) -> tuple[str, str] | None:
    """(title, text) of a page's main content; None if there is too little of it."""
    page = parse(html)
    title_tag = page.find("title")
    page.without(lambda e: e.tag in L.DROPPED_TAGS)
    page.without(lambda e: bool(_JUNK.search(f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}")))
    root = next((r for t in ("main", "article", "body") if (r := page.find(t)) is not None), page)
    own = title_tag.text() if title_tag is not None and len(title_tag.inside) == 1 else ""
    titles = [own, *(h.text() for h in (root.find("h1"), page.find("h1")) if h is not None)]
    title = next((t[: L.MAX_TITLE_CHARS] for t in titles if t), "Untitled")
    kept: list[str] = []
    todo = [e for e in reversed(root.inside) if isinstance(e, Element)]
    while todo:
        e = todo.pop()
        if e.tag not in L.BLOCK_TAGS or is_junk_block(e):
            continue
        direct = "".join(s for s in e.inside if isinstance(s, str) and s.strip()).strip()
        if e.tag in ("div", "section", "article") and len(direct) <= 80:
            todo.extend(x for x in reversed(e.inside) if isinstance(x, Element))
        elif e.text():
            kept.append(e.text())
    text = squeeze_paragraphs("\n\n".join(kept or root.text("\n").split("\n")))
    if len(text) < L.MIN_PAGE_CHARS or len(text.split()) < L.MIN_PAGE_WORDS:
        return None
    return title, text


def file_content(html: str | None) -> tuple[str, str]:
    """(first h1, all text without scripts and styles) of an HTML file."""
    page = parse(html)
    page.without(lambda e: e.tag in ("script", "style"))
    h1 = page.find("h1")
    return (h1.text() if h1 is not None else ""), page.text()


def _udf(of):
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of(h) or (None, None) for h in html], columns=["title", "text"])

    return F.pandas_udf(run, "title string, text string")


def page_content_column(html: Column) -> Column:
    """``title, text`` of a page's main content, both null if there is too little."""
    return _udf(page_content)(html)


def file_content_column(html: Column) -> Column:
    """``title, text`` of an HTML file."""
    return _udf(file_content)(html)

"""Trees of marked-up texts: one kind of node for HTML, Markdown, wiki text and LaTeX.

A parser makes candidates, not decisions: a line that begins with ``#1`` is a candidate
for a heading, ``$40 and $`` one for a formula. ``markup.py`` decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
import html
from html.parser import HTMLParser
import re

FAMILIES = ("html", "markdown", "wiki", "latex", "plain")
#: What a node can be by its marker; the order is part of the features.
MARKERS = (
    "root", "h", "li", "pre", "formula", "block", "inline", "drop", "quote", "atx", "hash", "setext", "fence", "indent",
    "display", "dollar", "wikihead", "wikilist", "wikicode", "lead", "section", "item", "verbatim", "environment", "text",
)


@dataclass
class Node:
    marker: str
    body: str = ""
    attrs: str = ""
    children: list[Node] = field(default_factory=list)
    #: Of HTML, and of what HTML stands in: the nodes with the texts between them, in order.
    flow: list[Node | str] | None = None

    def add(self, marker: str, body: str = "", attrs: str = "") -> Node:
        self.children.append(Node(marker, body, attrs))
        if self.flow is not None:
            self.flow.append(self.children[-1])
        return self.children[-1]


def all_nodes(root: Node) -> list[Node]:
    """The nodes in order, parents first; trees may be deeper than calls may nest."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def squeeze(text: str) -> str:
    return " ".join(text.split())


def spaced_lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


# Formulas within text

# What lies between delimiters holds no opening one, so that unclosed ones cost no more than a look.
_PAREN = r"\\\((?P<a>(?:(?!\\[()]).)+)\\\)"
_BRACKET = r"\\\[(?P<b>(?:(?!\\[\[\]]).)+)\\\]"
_DOLLARS = r"(?<!\\)\$\$(?P<c>(?:(?!\$\$).)+)\$\$"
_MATH = {
    "html": rf"{_PAREN}|{_BRACKET}|{_DOLLARS}",
    "markdown": rf"{_DOLLARS}|(?<![\\$\w])\$(?=[^\s$])(?P<d>[^$\n]+?(?:\n[^$\n]+?)?)(?<=[^\s\\])\$(?![\w$])|{_PAREN}|{_BRACKET}",
    "wiki": r"<math\b[^>/]*>(?P<a>(?:(?!</?math\b).)*)</math\s*>",
    "latex": rf"{_PAREN}|{_BRACKET}|{_DOLLARS}|(?<![\\$])\$(?=[^\s$])(?P<d>[^$]+?)(?<=[^\s\\])\$(?![\d$])",
}
_MATH_RE = {k: re.compile(v, re.S | re.I) for k, v in _MATH.items()}


def take_formulas(text: str, family: str, node: Node) -> str:
    """Adds the formulas within a text as children, and leaves them without their delimiters."""
    pattern = _MATH_RE.get(family)
    if pattern is None:
        return text
    held: list[str] = []

    def one(m: re.Match) -> str:
        body = next(g for g in m.groups() if g is not None)
        sure = m.groupdict().get("d") is None
        if family == "wiki":
            body = html.unescape(body)
        child = node.add("formula" if sure else "dollar", squeeze(body))
        if not sure and not (re.search(r"[\\^_=<>+]|^\s*\w\s*$", body)):
            child.attrs = "wordy"
            return m.group()
        held.append(body)
        return f"\x02{len(held) - 1}\x03"

    out = pattern.sub(one, text.replace("\x02", " "))
    return out if not held else out, held


def _with_formulas(text: str, family: str, node: Node, clean: Callable[[str], str]) -> str:
    taken = take_formulas(text, family, node)
    if isinstance(taken, str):
        return squeeze(clean(taken))
    left, held = taken
    out = clean(left)
    out = re.sub("\x02(\\d+)\x03", lambda m: held[int(m[1])], out)
    return squeeze(out)


# HTML

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("script style head template noscript iframe object svg nav title".split())
#: A head holds nothing else; its end tag may be left out.
_IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
_HEADING = re.compile("h[1-6]")
_CODE = frozenset("pre xmp listing".split())
_BLOCK = frozenset(
    "html body main article section header footer aside div p ul ol dl dt dd table tr td th thead tbody figure "
    "figcaption form fieldset address details summary center".split()
)
_ENDS = {  # an opening tag ends these open ones, up to the container
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_ENDS_P = _BLOCK | frozenset("h1 h2 h3 h4 h5 h6 pre blockquote li hr".split())
_FORMULA_CLASS = re.compile(r"\b(?:math|katex|mathjax|tex|equation|formula|latex)", re.I)
_COMMENT_AT_ONCE, _COMMENT_END = re.compile(r"-?>"), re.compile(r"--!?\s*>")
_LONG_NUMBER = re.compile(r"&#0*([0-9]*);?")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.stack: list[tuple[str, Node]] = [("", self.root)]
        self.parts: dict[int, list[str]] = {id(self.root): []}
        self.open: Counter[str] = Counter()  # the tags on the stack, so that a deep one is seldom searched
        self.comments_end = self.cdata_ends = True  # whether those still to come may have an end

    def parse_comment(self, i: int, report: int = 1) -> int:
        """Passes over a comment; of one that never ends, over its opening alone."""
        end = _COMMENT_AT_ONCE.match(self.rawdata, i + 4) or self.comments_end and _COMMENT_END.search(self.rawdata, i + 4)
        self.comments_end = bool(end)
        return end.end() if end else i + 4

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """CDATA is text; whatever else begins with ``<![`` is passed over up to its ``>``."""
        if self.cdata_ends and self.rawdata.startswith("<![CDATA[", i):
            end = self.rawdata.find("]]>", i)
            self.cdata_ends = end >= 0
            if self.cdata_ends:
                self.handle_data(self.rawdata[i + 9 : end])
                return end + 3
        return self.parse_bogus_comment(i, report)

    def close_from(self, k: int) -> None:
        self.open.subtract(t for t, _ in self.stack[k:])
        del self.stack[k:]

    def close_head(self) -> None:
        self.close_from(next(k for k, (t, _) in enumerate(self.stack) if t == "head"))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open["head"] and (tag == "body" or self.stack[-1][0] == "head" and tag not in _IN_HEAD):
            self.close_head()
        if tag in _ENDS and any(self.open[t] for t in _ENDS[tag][0]):
            closed, container = _ENDS[tag]
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in container:
                    break
                if self.stack[k][0] in closed:
                    self.close_from(k)
                    break
        if tag in _ENDS_P and self.open["p"]:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] == "p":
                    self.close_from(k)
                    break
                if self.stack[k][0] in ("li", "td", "div", "blockquote"):
                    break
        if _HEADING.fullmatch(tag) and _HEADING.fullmatch(self.stack[-1][0]):  # an unclosed heading ends at the next
            self.close_from(len(self.stack) - 1)
        if tag in ("br", "hr", "img"):
            self.parts[id(self.stack[-1][1])].append("\n" if tag == "br" else " ")
        if tag in _VOID:
            return
        if any(self.open[t] for t in _CODE):
            marker = "inline"
        elif _HEADING.fullmatch(tag):
            marker = "h"
        elif tag == "li":
            marker = "li"
        elif tag in _CODE:
            marker = "pre"
        elif tag in _DROP:
            marker = "drop"
        elif tag == "blockquote":
            marker = "quote"
        elif tag == "math" and not self.open["math"]:
            marker = "formula"
        elif tag in _BLOCK:
            marker = "block"
        else:
            marker = "inline"
        token = " ".join(str(v) for k, v in attrs if k in ("class", "id", "type", "role") and v)
        node = Node(marker, attrs=token)
        parent = self.stack[-1][1]
        parent.children.append(node)
        self.parts[id(node)] = []
        self.parts[id(parent)].append(node)
        self.stack.append((tag, node))
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self.close_from(k)
                return
            if self.stack[k][0] in ("ul", "ol", "table") and tag in ("p", "div", "span", "b", "i", "em", "a"):
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "hr", "img"):
            self.parts[id(self.stack[-1][1])].append("\n" if tag == "br" else " ")

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] == "head" and data.strip():
            self.close_head()
        self.parts[id(self.stack[-1][1])].append(data)

    def finish(self) -> list[tuple[Node, bool]]:
        """The nodes, parents first, each with whether it lies in code, a formula or a dropped node."""
        out, stack = [], [(self.root, False)]
        while stack:
            node, inside = stack.pop()
            out.append((node, inside))
            stack.extend((c, inside or c.marker in ("pre", "drop", "formula")) for c in reversed(node.children))
        self.with_items: set[int] = set()
        for node, _ in reversed(out):
            if any(c.marker == "li" or id(c) in self.with_items for c in node.children):
                self.with_items.add(id(node))
        return out

    def text(self, node: Node, own: bool = False) -> str:
        """The text of a node; own: without blocks, lists and dropped nodes within. Of a heading: without those within."""
        out: list[str] = []
        stack = [*reversed(self.parts.get(id(node), ()))]
        while stack:
            p = stack.pop()
            if isinstance(p, str):
                out.append(p)
            elif p.marker == "drop" or p.marker == node.marker == "h":
                out.append(" ")
            elif own and p.marker in ("li", "h", "pre", "quote") or own and p.marker == "block" and id(p) in self.with_items:
                out.append(" ")
            else:
                if p.marker in ("block", "li", "h", "quote"):
                    out.append(" ")
                    stack.append(" ")
                stack.extend(reversed(self.parts.get(id(p), ())))
        return "".join(out)


def parse_html(text: str) -> Node:
    """The nodes of a text, broken declarations and all; the texts between them stand in their ``flow``."""
    builder = _Builder()
    # longer numbers than any character has are more than int() takes
    builder.feed(_LONG_NUMBER.sub(lambda m: m.group() if len(m.group()) < 99 else "\ufffd" if len(m[1]) > 7 else f"&#{m[1] or 0};", text))
    builder.close()

    def within(p: Node | str) -> str:
        """What a part adds to a text with formulas: emphasis within one belongs to it."""
        if isinstance(p, str):
            return p
        texts = builder.parts[id(p)]
        if p.children or p.marker != "inline" or any("\\" in t or "$$" in t for t in texts):
            return " "
        return "".join(texts)

    def fill(node: Node, inside: bool) -> None:
        if node.marker == "pre":
            node.body = squeeze(builder.text(node))
        elif node.marker in ("h", "li", "formula"):
            raw = builder.text(node, own=node.marker == "li")
            node.body = _with_formulas(raw, "html", node if not inside else Node("root"), str)
        elif not inside and node.marker in ("block", "inline", "root", "quote"):
            direct = "".join(p if isinstance(p, str) else " " for p in builder.parts.get(id(node), ()))
            if node.marker == "inline" and _FORMULA_CLASS.search(node.attrs):
                node.marker = "formula"
                raw = builder.text(node)
                node.body = squeeze(re.sub(r"^\s*(?:\\[(\[]|\$\$?)|(?:\\[)\]]|\$\$?)\s*$", "", raw.strip()))
            elif "\\" in direct or "$$" in direct:
                _with_formulas("".join(map(within, builder.parts[id(node)])), "html", node, str)

    def prune(node: Node) -> None:
        # formulas that an enclosing heading or item took already stand there once
        seen: set[str] = set()
        keep = []
        for c in node.children:
            if c.marker == "formula" and node.marker in ("h", "li"):
                if c.body in seen:
                    continue
                seen.add(c.body)
            keep.append(c)
        node.children = keep

    for node, inside in reversed(builder.finish()):
        fill(node, inside)
    for node in all_nodes(builder.root):
        prune(node)
        node.flow = builder.parts.get(id(node))
    return builder.root


def take_html(node: Node, text: str) -> None:
    """Adds the nodes of a piece of HTML to a node of another family."""
    part = parse_html(text)
    if node.flow is None:
        node.flow = [*node.children]
    node.children.extend(part.children)
    node.flow.append(part)


def html_run(text: str) -> tuple[str, list[str]]:
    """A text between the nodes of HTML with its formulas bare, and these formulas where it holds nothing else."""
    if "\\" not in text and "$$" not in text:
        return squeeze(text), []
    root = Node("root")
    body = _with_formulas(text, "html", root, str)
    return body, [] if _MATH_RE["html"].sub("", text).strip() else [c.body for c in root.children if c.body]


# Markdown

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_HASH = re.compile(r"^ {0,3}(#{1,6})([^#\s].*)$")
_ITEM = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])[ \t]+(\S.*)$")
_SETEXT = re.compile(r"^ {0,3}(=+|-{2,})[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_HTML_BLOCK = re.compile(
    r"^ {0,3}</?(?:h[1-6]|p|div|ul|ol|li|pre|table|tr|td|th|blockquote|section|article|details|summary|html|head|body|script|style|center)\b",
    re.I,
)
_REFERENCE = re.compile(r"^ {0,3}\[[^\]]+\]:\s*\S+")


def clean_markdown(text: str) -> str:
    codes: list[str] = []

    def code(m: re.Match) -> str:
        codes.append(m[2].strip() if m[2].strip() else m[2])
        return f"\x04{len(codes) - 1}\x05"

    t = re.sub(r"(?<![\\`])(`+)(?!`)(.+?)(?<!`)\1(?!`)", code, text, flags=re.S)
    t = re.sub(r"<!--.*?-->", "", t, flags=re.S)
    t = re.sub(r"\\([\\`*_{}\[\]()#+.!~|<>$&\"'-])", lambda m: f"\x06{ord(m[1])}\x07", t)
    t = re.sub(r"!\[([^\]]*)\]\((?:[^()\s]|\([^()]*\))*(?:\s+[\"'][^\"']*[\"'])?\)", r"\1", t)
    t = re.sub(r"\[\^[^\]]+\]", "", t)
    t = re.sub(r"\[([^\[\]]*)\]\(\s*<?(?:[^()\s]|\([^()]*\))*>?(?:\s+[\"'][^\"']*[\"'])?\s*\)", r"\1", t)
    t = re.sub(r"\[([^\[\]]+)\]\[[^\[\]]*\]", r"\1", t)
    t = re.sub(r"<((?:https?|mailto):[^>\s]+)>", r"\1", t)
    t = re.sub(r"</?[A-Za-z][^<>]*>", "", t)
    for _ in range(2):
        t = re.sub(r"(?<!\*)\*\*(?=\S)(.+?)(?<=\S)\*\*(?!\*)", r"\1", t, flags=re.S)
        t = re.sub(r"(?<![\w_])__(?=\S)(.+?)(?<=\S)__(?![\w_])", r"\1", t, flags=re.S)
        t = re.sub(r"(?<![\w*])\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?![\w*])", r"\1", t, flags=re.S)
        t = re.sub(r"(?<![\w_])_(?=[^\s_])(.+?)(?<=[^\s_])_(?![\w_])", r"\1", t, flags=re.S)
        t = re.sub(r"~~(?=\S)(.+?)(?<=\S)~~", r"\1", t, flags=re.S)
    t = html.unescape(t)
    t = re.sub("\x06(\\d+)\x07", lambda m: chr(int(m[1])), t)
    return re.sub("\x04(\\d+)\x05", lambda m: codes[int(m[1])], t)


def parse_markdown(text: str) -> Node:
    top = Node("root")
    pending = [(top, text)]
    while pending:
        pending.extend(_fill_markdown(*pending.pop()))
    return top


def _fill_markdown(root: Node, text: str) -> list[tuple[Node, str]]:
    """Adds the blocks of a text; quotations come back with their texts, to be filled in turn."""
    quotes: list[tuple[Node, str]] = []
    lines = spaced_lines(text)
    i, n = 0, len(lines)
    para: list[str] = []
    blank_before = True

    def flush() -> None:
        if para:
            node = root.add("text")
            node.body = _with_formulas("\n".join(para), "markdown", node, clean_markdown)
            para.clear()

    def opens(line: str) -> bool:
        return bool(
            _FENCE.match(line) or _ATX.match(line) or _ITEM.match(line) or line.lstrip().startswith((">", "$$"))
            or _HTML_BLOCK.match(line) or line.lstrip().startswith("<!--")
        )

    while i < n:
        line = lines[i]
        if not line.strip():
            flush()
            blank_before = True
            i += 1
            continue
        fence = _FENCE.match(line)
        if fence:
            flush()
            j = i + 1
            end = re.compile(r"^ {0,3}" + re.escape(fence[1][0]) + "{" + str(len(fence[1])) + r",}\s*$")
            while j < n and not end.match(lines[j]):
                j += 1
            root.add("fence", squeeze("\n".join(lines[i + 1 : j])), fence[2].strip())
            i = j + 1
        elif line.lstrip().startswith("$$"):
            flush()
            first = line.strip()
            if len(first) > 4 and first.endswith("$$"):
                root.add("display", squeeze(first[2:-2]))
                i += 1
            else:
                j = i + 1
                while j < n and not lines[j].rstrip().endswith("$$"):
                    j += 1
                if j < n:
                    root.add("display", squeeze("\n".join([first[2:], *lines[i + 1 : j], lines[j].rstrip()[:-2]])))
                    i = j + 1
                else:
                    para.append(line)
                    i += 1
        elif line.lstrip().startswith("\\[") and not para:
            j = i
            while j < n and "\\]" not in lines[j] and lines[j].strip():
                j += 1
            chunk = "\n".join(lines[i : j + 1])
            node = root.add("text")
            node.body = _with_formulas(chunk, "markdown", node, clean_markdown)
            i = j + 1
        elif line.lstrip().startswith("<!--"):
            flush()
            j = i
            while j < n and "-->" not in lines[j]:
                j += 1
            root.add("drop")
            if j < n and (tail := lines[j].split("-->", 1)[1].strip()):
                lines[j] = tail
                i = j
            else:
                i = j + 1
        elif blank_before and not para and re.match(r"^(?: {4}|\t)", line):
            j = i
            block = []
            while j < n and (re.match(r"^(?: {4}|\t)", lines[j]) or not lines[j].strip()):
                block.append(re.sub(r"^(?: {4}|\t)", "", lines[j]))
                j += 1
            while block and not block[-1].strip():
                block.pop()
            root.add("indent", squeeze("\n".join(block)))
            i = j
            blank_before = True
            continue
        elif _HTML_BLOCK.match(line):
            flush()
            j = i + 1
            raw = re.match(r"^ {0,3}<(pre|script|style)\b", line, re.I)
            if raw:
                close = re.compile(rf"</{raw[1]}\s*>", re.I)
                while j < n and not close.search("\n".join(lines[i:j])):
                    j += 1
            else:
                while j < n and lines[j].strip():
                    j += 1
            take_html(root, "\n".join(lines[i:j]))
            i = j
        elif _ATX.match(line):
            flush()
            node = root.add("atx")
            node.body = _with_formulas(_ATX.match(line)[2] or "", "markdown", node, clean_markdown)
            i += 1
        elif not para and _HASH.match(line):
            node = root.add("hash")
            node.body = squeeze(clean_markdown(_HASH.match(line)[2]))
            para.append(line)
            i += 1
        elif para and _SETEXT.match(line):
            node = root.add("setext")
            node.body = _with_formulas("\n".join(para), "markdown", node, clean_markdown)
            para.clear()
            i += 1
        elif _RULE.match(line):
            flush()
            i += 1
        elif _ITEM.match(line) and (not para or not line.lstrip()[0].isdigit() or line.lstrip().startswith("1")):
            flush()
            m = _ITEM.match(line)
            rest = [m[3]]
            j = i + 1
            while j < n and lines[j].strip() and not opens(lines[j]) and not _SETEXT.match(lines[j]):
                rest.append(lines[j].strip())
                j += 1
            node = root.add("li", attrs="ordered" if m[2][0].isdigit() else "")
            node.body = _with_formulas(re.sub(r"^\[[ xX]\]\s+", "", "\n".join(rest)), "markdown", node, clean_markdown)
            i = j
        elif line.lstrip().startswith(">"):
            flush()
            j, inner = i, []
            while j < n and lines[j].strip() and (lines[j].lstrip().startswith(">") or not opens(lines[j])):
                inner.append(re.sub(r"^\s*> ?", "", lines[j]))
                j += 1
            quotes.append((root.add("quote"), "\n".join(inner)))
            i = j
        elif not para and _REFERENCE.match(line):
            root.add("drop")
            i += 1
        else:
            para.append(line)
            i += 1
        blank_before = False
    flush()
    return quotes


# Wiki text

_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$")
_WIKI_LIST = re.compile(r"^([*#]+)[:;]*[ \t]*(.*)$")
_WIKI_CODE = re.compile(r"<(source|syntaxhighlight|pre|nowiki|code)\b([^>]*)>((?:(?!<\1\b).)*?)</\1\s*>", re.S | re.I)
_WIKI_REF = re.compile(r"<ref\b[^>]*/>|<ref\b[^>]*>(?:(?!<ref\b).)*?</ref\s*>|<references\s*/?>", re.S | re.I)


def _without_templates(text: str) -> str:
    """Removes {{...}} and {|...|}, nested ones too; unclosed ones stay."""
    out, stack, last = [], [], 0
    for m in re.finditer(r"\{\{|\}\}|\{\||\|\}", text):
        mark = m.group()
        if mark in ("{{", "{|"):
            stack.append((mark, m.start()))
        elif stack and stack[-1][0] == ("{{" if mark == "}}" else "{|"):
            begin = stack.pop()[1]
            if not stack and begin >= last:
                out.append(text[last:begin])
                last = m.end()
    out.append(text[last:])
    return "".join(out)


def clean_wiki(text: str) -> str:
    t = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    t = _WIKI_REF.sub("", t)
    t = _without_templates(t)
    t = re.sub(r"\[\[(?:File|Image|Category|Datei|Bild|Kategorie|Fichier|Archivo):[^\[\]]*(?:\[\[[^\]]*\]\][^\[\]]*)*\]\]", "", t, flags=re.I)
    t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", t)
    t = re.sub(r"\[(?:https?|ftp|mailto):[^\s\]]+\s+([^\]]*)\]", r"\1", t)
    t = re.sub(r"\[(?:https?|ftp|mailto):[^\s\]]+\]", "", t)
    t = re.sub(r"'{2,5}", "", t)
    t = re.sub(r"__[A-Z]+__", "", t)
    t = re.sub(r"</?[A-Za-z][^<>]*>", "", t)
    return html.unescape(t)


def parse_wiki(text: str) -> Node:
    root = Node("root")
    held: list[tuple[str, str, str]] = []

    def hold(m: re.Match) -> str:
        if m[1].lower() in ("nowiki", "code") and "\n" not in m[3]:
            return m[3] if m[1].lower() == "code" else re.sub(r"[\[\]{}'=*#<>]", lambda c: f"&#{ord(c[0])};", m[3])
        held.append((m[1].lower(), m[2], m[3]))
        return f"\n\x0e{len(held) - 1}\x0f\n"

    t = _WIKI_CODE.sub(hold, "\n".join(spaced_lines(text)))
    t = re.sub(r"<!--.*?-->", "", t, flags=re.S)
    t = _WIKI_REF.sub("", t)
    math: list[str] = []

    def formula(m: re.Match) -> str:
        math.append(m.group())
        return f"\x10{len(math) - 1}\x11"

    t = _without_templates(_MATH_RE["wiki"].sub(formula, t))
    t = re.sub("\x10(\\d+)\x11", lambda m: math[int(m[1])], t)
    para: list[str] = []

    def flush() -> None:
        if para:
            node = root.add("text")
            node.body = _with_formulas("\n".join(para), "wiki", node, clean_wiki)
            para.clear()

    lines = t.split("\n")
    k = 0
    while k < len(lines):
        line = lines[k]
        code = re.fullmatch("\x0e(\\d+)\x0f", line.strip())
        if code:
            flush()
            tag, attrs, body = held[int(code[1])]
            root.add("wikicode", squeeze(body), attrs)
        elif not line.strip():
            flush()
        elif m := _WIKI_HEAD.match(line):
            flush()
            node = root.add("wikihead")
            node.body = _with_formulas(m[2], "wiki", node, clean_wiki)
        elif m := _WIKI_LIST.match(line):
            flush()
            node = root.add("wikilist", attrs=m[1])
            node.body = _with_formulas(m[2], "wiki", node, clean_wiki)
        elif line.startswith(" ") and not para:
            block = []
            while k < len(lines) and lines[k].startswith(" ") and lines[k].strip():
                block.append(lines[k][1:])
                k += 1
            root.add("lead", squeeze("\n".join(block)))
            continue
        elif re.match(r"^\s*</?(?:ul|ol|li|h[1-6]|p|div)\b", line, re.I):
            flush()
            block = []
            while k < len(lines) and lines[k].strip():
                block.append(lines[k])
                k += 1
            take_html(root, "\n".join(block))
            continue
        else:
            para.append(line)
        k += 1
    flush()
    return root


# LaTeX

_VERBATIM = re.compile(
    r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt|listing)\}((?:\[[^\]]*\])?(?:\{[^}]*\})?)(.*?)\\end\{\1\}", re.S
)
_EQUATION = re.compile(
    r"\\begin\{((?:equation|align|gather|multline|displaymath|math|eqnarray|flalign|alignat)\*?)\}(.*?)\\end\{\1\}"
    r"|\\\[(.+?)\\\]|(?<!\\)\$\$(.+?)\$\$",
    re.S,
)
_SECTION = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\s*(?:\[[^\]]*\])?\s*(?=\{)")
_SILENT = re.compile(
    r"\\(?:label|ref|eqref|pageref|cite[a-z]*|footnote|footnotetext|index|bibliography|bibliographystyle|usepackage|"
    r"documentclass|input|include|includegraphics|vspace|hspace|pagestyle|setlength|newcommand|renewcommand)\*?"
    r"(?:\[[^\]]*\])*(?=\{)"
)
_LATEX_SIGNS = {
    "\\&": "&", "\\%": "%", "\\$": "$", "\\#": "#", "\\_": "_", "\\{": "{", "\\}": "}", "\\ ": " ", "\\,": " ", "\\;": " ",
    "\\textbackslash": "\\", "\\textasciitilde": "~", "\\ldots": "…", "\\dots": "…", "\\LaTeX": "LaTeX", "\\TeX": "TeX",
    "\\quad": " ", "\\qquad": " ", "\\newline": " ", "\\\\": " ", "\\-": "",
}


def group_end(text: str, at: int) -> int:
    """Position behind the group that opens at ``at``; the end of the text if it never closes."""
    depth, i = 0, at
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(text)


def _drop_groups(text: str) -> str:
    out, last = [], 0
    for m in _SILENT.finditer(text):
        if m.start() < last:
            continue
        out.append(text[last : m.start()])
        last = group_end(text, m.end())
    out.append(text[last:])
    return "".join(out)


def clean_latex(text: str) -> str:
    t = _drop_groups(re.sub(r"(?<!\\)%[^\n]*", "", text))
    t = re.sub(r"\\href\s*\{[^{}]*\}\s*(?=\{)", "", t)
    t = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?", " ", t)
    signs: list[str] = []

    def sign(m: re.Match) -> str:
        signs.append(_LATEX_SIGNS[m[1]])
        return f"\x12{len(signs) - 1}\x13"

    t = re.sub(r"(\\(?:[&%$#_{} ,;\\-]|(?:textbackslash|textasciitilde|ldots|dots|LaTeX|TeX|qquad|quad|newline)(?![a-zA-Z])))(?:\{\})?", sign, t)
    t = re.sub(r"\\verb\*?([^\w\s])(.*?)\1", r"\2", t)
    t = re.sub(r"\\item\b(?:\s*\[([^\]]*)\])?", r"\1 ", t)
    t = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?[ \t]*(?=\{)", "", t)
    t = re.sub(r"\\[a-zA-Z]+\*?[ \t]*", "", t)
    t = t.replace("{", "").replace("}", "").replace("~", " ")
    t = re.sub("\x12(\\d+)\x13", lambda m: signs[int(m[1])], t)
    return html.unescape(t)


def parse_latex(text: str) -> Node:
    root = Node("root")
    held: list[Node] = []

    def hold(node: Node) -> str:
        held.append(node)
        return f"\n\n\x0e{len(held) - 1}\x0f\n\n"

    t = "\n".join(spaced_lines(text))
    if "\\begin{document}" in t:
        t = t.split("\\begin{document}", 1)[1]
    t = t.split("\\end{document}", 1)[0]
    t = _VERBATIM.sub(lambda m: hold(Node("verbatim", squeeze(m[3]), m[1])), t)
    t = re.sub(r"\\begin\{comment\}.*?\\end\{comment\}", "", t, flags=re.S)
    t = re.sub(r"(?<!\\)%[^\n]*", "", t)
    t = _EQUATION.sub(
        lambda m: hold(Node("environment", squeeze(re.sub(r"\\label\{[^}]*\}", "", m[2] or m[3] or m[4] or "")), m[1] or "")), t
    )

    def put(chunk: str, marker: str, parent: Node) -> None:
        """Text of one node, with what stands held within it as its children."""
        node = Node(marker)
        inner = [held[int(k)] for k in re.findall("\x0e(\\d+)\x0f", chunk)]
        bare = re.sub("\x0e(\\d+)\x0f", lambda m: " " + (held[int(m[1])].body if marker != "text" and held[int(m[1])].marker == "environment" else "") + " ", chunk)
        node.body = _with_formulas(bare, "latex", node, clean_latex)
        node.children.extend(inner)
        if node.body or node.children:
            parent.children.append(node)

    def block(chunk: str, parent: Node) -> None:
        """Sections, items and paragraphs of a piece of text."""
        at = 0
        for m in [*re.finditer(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\s*(?:\[[^\]]*\])?\s*(?=\{)|\\begin\{(itemize|enumerate|description|compactitem)\}(?:\[[^\]]*\])?", chunk)]:
            if m.start() < at:
                continue
            for p in re.split(r"\n\s*\n", chunk[at : m.start()]):
                if p.strip():
                    put(p, "text", parent)
            if m[1]:
                at = items(chunk, m.end(), m[1], parent)
            else:
                end = group_end(chunk, m.end())
                put(chunk[m.end() : end], "section", parent)
                at = end
        for p in re.split(r"\n\s*\n", chunk[at:]):
            if p.strip():
                put(p, "text", parent)

    def items(chunk: str, begin: int, name: str, parent: Node) -> int:
        """The items of a list from ``begin``, lists within them too; position behind its end."""
        pattern = re.compile(r"\\item\b(?:\s*\[[^\]]*\])?|\\begin\{(itemize|enumerate|description|compactitem)\}(?:\[[^\]]*\])?|\\end\{(itemize|enumerate|description|compactitem)\}")
        groups: list[Node] = []
        currents: list[list[str] | None] = []

        def open_list(under: Node) -> None:
            groups.append(Node("block"))
            currents.append(None)
            under.children.append(groups[-1])

        open_list(parent)
        at = begin
        while m := pattern.search(chunk, at):
            if currents[-1] is not None:
                currents[-1].append(chunk[at : m.start()])
            at = m.end()
            if m[1]:
                open_list(groups[-1])
                continue
            if currents[-1] is not None:
                put("".join(currents[-1]), "item", groups[-1])
            if m[2]:
                groups.pop()
                currents.pop()
                if not groups:
                    return at
                continue
            label = re.search(r"\[([^\]]*)\]", m.group())
            currents[-1] = [label[1] + " "] if label else []
        while groups:  # never closed
            group, current = groups.pop(), currents.pop()
            if current is not None:
                put("".join(current) + chunk[at:], "item", group)
            at = len(chunk)
        return len(chunk)

    block(t, root)
    return root


def parse_plain(text: str) -> Node:
    root = Node("root")
    for p in re.split(r"\n\s*\n", "\n".join(spaced_lines(text))):
        if p.strip():
            root.add("text", squeeze(p))
    return root


PARSERS: dict[str, Callable[[str], Node]] = {
    "html": parse_html, "markdown": parse_markdown, "wiki": parse_wiki, "latex": parse_latex, "plain": parse_plain,
}


def clean_inline(text: str, family: str) -> str:
    """Plain text of one line of a family, formulas without their delimiters."""
    if family == "html":
        return squeeze(_html_text(text))
    if family == "plain":
        return squeeze(text)
    clean = {"markdown": clean_markdown, "wiki": clean_wiki, "latex": clean_latex}[family]
    return _with_formulas(text, family, Node("root"), clean)


def _html_text(text: str) -> str:
    t = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", "", text, flags=re.S | re.I)
    t = re.sub(r"</?[A-Za-z][^<>]*>", "", t)
    return html.unescape(t)

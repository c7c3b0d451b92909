"""Clean text and structure of marked-up documents.

Method: gradient-boosted trees over the nodes of a document's tree. A text is parsed under
each markup family that leaves a trace in it; trees over the features of the root choose
the family, whatever the suffix says. Trees over the features of each node (marker,
attribute tokens, depth, siblings, density of its subtree) then give the probabilities of
its kinds. Hierarchical decoding takes the most probable labelling of the whole tree in
which nothing within a code block, formula or dropped node is a piece of its own, and no
heading holds a heading or list item.

The trees are trained on texts generated here in all families (``TRAIN_TEXTS``), whose
pieces are known; a text of no family has none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcorpus.llm.common import KEY, in_folder
from voxcorpus.llm.markup_trees import FAMILIES, MARKERS, PARSERS, Node, all_nodes, clean_inline, html_run, squeeze
from voxcorpus.llm.trees import Trees

#: Generated texts the trees are trained on.
TRAIN_TEXTS = 4_000
KINDS = ("none", "heading", "list_item", "code", "formula", "drop")
#: Nothing within these is a piece; within a heading no heading or item is.
SEALED = ("code", "formula", "drop")

# Traces of the families; each is counted in the text.
_TRACES = [
    re.compile(p, f)
    for p, f in (
        (r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?>", 0),
        (r"</(?:p|div|h[1-6]|ul|ol|li|html|body|pre|b|em|span|a)\s*>", re.I),
        (r"&(?:#\d+|#x[0-9a-f]+|[a-z]{2,8});", re.I),
        (r"^ {0,3}#{1,6} \S", re.M),
        (r"^#{1,6}[^#\s]", re.M),
        (r"^ {0,3}(?:`{3,}|~{3,})", re.M),
        (r"\[[^\[\]\n]+\]\([^()\s]+\)", 0),
        (r"\*\*[^*\n]+\*\*|(?<![*\w])\*[^*\s][^*\n]*\*(?![*\w])", 0),
        (r"`[^`\n]+`", 0),
        (r"^\s*(?:[-*+]|\d+[.)]) \S", re.M),
        (r"^[^\n]+\n(?:={3,}|-{3,})\s*$", re.M),
        (r"^\s*>", re.M),
        (r"\$\$|(?<!\\)\$[^$\n]*[\\^_=][^$\n]*\$", 0),
        (r"^(={2,6})[^=\n].*?\1\s*$", re.M),
        (r"'{2,5}[^'\n]+'{2,5}", 0),
        (r"\[\[[^\[\]\n]+\]\]|\{\{[^{}]*\}\}|\{\|", 0),
        (r"\[https?:\S+ [^\]\n]+\]", 0),
        (r"<(?:ref|math|source|syntaxhighlight|nowiki)\b", re.I),
        (r"^[*#]{2,}|^[*#][^\s*#]", re.M),
        (r"\\(?:begin|end)\{", 0),
        (r"\\(?:(?:sub)*section|chapter|paragraph)\*?\{", 0),
        (r"\\[a-zA-Z]+\{", 0),
        (r"\\item\b", 0),
        (r"\\[&%$#_]", 0),
        (r"^\s*%", re.M),
        (r"\\\(|\\\[", 0),
        (r"^(?: {4}|\t)\S", re.M),
    )
]
#: Which traces speak for a family; their sum is a feature.
_SPEAK_FOR = ((0, 1, 2), (3, 5, 6, 7, 8, 9, 10, 11, 12, 26), (13, 14, 15, 16, 17, 18), (19, 20, 21, 22, 23, 25), (3, 5, 7, 8, 9, 10))
_SUFFIXES = ("html", "htm", "md", "markdown", "wiki", "mediawiki", "tex", "latex", "txt")


def suffix_of(path: str | None) -> str:
    m = re.search(r"\.(\w+)$", path or "")
    return m[1].lower() if m else ""


def root_features(text: str, suffix: str) -> list[float]:
    """Counts of the traces (as logs), their shares of the text and of lines, and the suffix."""
    spans = [[m.end() - m.start() for m in p.finditer(text)] for p in _TRACES]
    counts = [len(s) for s in spans]
    lines = text.count("\n") + 1
    blank = len(re.findall(r"\n\s*\n", text))
    joined = len(re.findall(r"^#.*\n#", text, re.M))
    return [
        *np.log1p(counts).tolist(),
        *(sum(s) / len(text) for s in spans),
        *(float(sum(counts[i] for i in group)) for group in _SPEAK_FOR),
        counts[3] / lines,
        counts[9] / lines,
        joined,
        lines,
        blank / lines,
        *(float(suffix == s) for s in _SUFFIXES),
    ]


def family_candidates(text: str) -> bool:
    """Whether any family leaves a trace."""
    return any(p.search(text) for p in _TRACES)


_CLASSES = re.compile(r"math|katex|tex\b|equation|formula", re.I), re.compile(r"code|highlight|lang|sh\b|python", re.I)


def node_features(root: Node, family: str) -> tuple[list[Node], np.ndarray, list[int]]:
    """Nodes in order, their features, and the positions of their parents."""
    nodes, parents, rows = [], [], []
    fam = [float(family == f) for f in FAMILIES]

    sizes: dict[int, tuple[int, int]] = {}
    for n in reversed(all_nodes(root)):
        below = [sizes[id(c)] for c in n.children]
        sizes[id(n)] = len(n.body) + sum(a for a, _ in below), 1 + sum(b for _, b in below)
    todo = [(root, -1, 0, 0, [root], Counter([root.marker]))]
    while todo:
        n, parent, depth, index, siblings, alike = todo.pop()
        me = len(nodes)
        nodes.append(n)
        parents.append(parent)
        body = n.body
        length = len(body) or 1
        words = body.split()
        chars, count = sizes[id(n)]
        same = alike[n.marker]
        before = siblings[index - 1].marker if index else ""
        after = siblings[index + 1].marker if index + 1 < len(siblings) else ""
        marks = Counter(c.marker for c in n.children)
        rows.append([
            *(float(n.marker == m) for m in MARKERS),
            *fam,
            *(float(_may_be(n, k)) for k in KINDS[1:5]),
            float(n.attrs == "wordy"),
            *(float(bool(p.search(n.attrs))) for p in _CLASSES),
            float(len(n.attrs)),
            float(depth),
            float(index),
            float(len(siblings)),
            same / max(1, len(siblings)),
            float(before == n.marker),
            float(after == n.marker),
            float(before in ("li", "item", "wikilist")),
            chars / count,
            float(count),
            float(len(body)),
            float(len(words)),
            sum(map(str.isalpha, body)) / length,
            sum(map(str.isdigit, body)) / length,
            sum(c in "\\^_={}<>()[];$" for c in body) / length,
            float(body[-1:] in ".!?"),
            float(body[:1].isdigit()),
            float(body[:1].isupper()),
            float(len(re.findall(r"[.!?]\s+[A-Z]", body))),
            float(marks["drop"]),
            float(marks["formula"] + marks["dollar"]),
            float(MARKERS.index(nodes[parent].marker)) if parent >= 0 else -1.0,
        ])
        todo.extend((n.children[i], me, depth + 1, i, n.children, marks) for i in range(len(n.children) - 1, -1, -1))
    return nodes, np.array(rows), parents


# Texts to train on: generated in every family, with their pieces known.

_SYLLABLES = "ba de ki lo mu na pe ri so ta vu we zo fi ga ho ju ke la mi no pa re si to".split()


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(1, 4)))


def _words(rng: random.Random, a: int, b: int) -> list[str]:
    return [_word(rng) for _ in range(rng.randrange(a, b))]


def _formula(rng: random.Random) -> str:
    x, y, n = rng.choice("abcxyz"), rng.choice("ijkmn"), rng.randrange(2, 99)
    return rng.choice([
        rf"{x}^2 + {y}^2 = {n}", rf"\frac{{{x}_{y}}}{{{n}}}", rf"\sum_{y} {x}_{y} \leq {n}", rf"{x}_{{{y}}} = \alpha {n}",
        rf"\hat{{{x}}} \cdot {n}", rf"f({x}) = \log(1 + {x} / {n})", f"{x} = {n}", rf"p({x} \mid {y}) \geq 0.{n}",
    ])


def _code(rng: random.Random) -> str:
    a, b = _word(rng), _word(rng)
    return rng.choice([
        f"# {a} the {b}\nfor x in {a}:\n    print({b} * 2)", f"* {a} *\n- {b}\n== {a} ==", f'{{"{a}": [1, 2, 3]}}',
        f"def {a}(x):\n    return x < 3 and x > 0", f"export {a}=$HOME/{b}\nls -l | grep {a}", f"let {a} = b && c;\nif (a < 3) {{ {b}(); }}",
        f"SELECT {a}, count(1)\n  FROM {b}\n GROUP BY 1", f"1. {a}\n2. {b}", f"\\{a}{{x}} % {b}", f"<{a}>{b}</{a}>",
    ])


_TRAPS = [
    "#1 on the {0} is the {1}.", "We paid $40 for the {0} and $60 for the {1}.", "If a < b and c > d, then {0}.",
    "The {0} is 2 * 3 * 7 this week.", "They kept the_{0}_file [sic] and left -- {1}.", "R&D asked about the {0} & the {1}.",
    "Call it C:\\drafts\\{0} for now.", "Rates fell by 8% ~ twice the {0}.", "Tip #1 is to trim the {0}.",
]


def _styled(words: list[str], family: str, rng: random.Random, ready: bool = True) -> tuple[str, str]:
    """(source, plain text) of a line with inline markup here and there."""
    out, plain = [], []
    for w in words:
        k = rng.random()
        if k < 0.8 or not ready or family == "plain":
            out.append(w)
        elif family == "html":
            t = rng.choice([("<b>", "</b>"), ('<em class="x">', "</em>"), ("<SPAN>", "</SPAN>"), ("<a href='https://x.example/y'>", "</a>")])
            out.append(t[0] + w + t[1])
        elif family == "markdown":
            out.append(rng.choice([f"**{w}**", f"*{w}*", f"`{w}`", f"[{w}](https://x.example/y)"]))
        elif family == "wiki":
            out.append(rng.choice([f"'''{w}'''", f"''{w}''", f"[[{w.title()}|{w}]]", f"[https://x.example/y {w}]"]))
        else:
            out.append(rng.choice([rf"\emph{{{w}}}", rf"\textbf{{{w}}}", rf"\texttt{{{w}}}", rf"\href{{https://x.example/y}}{{{w}}}"]))
        plain.append(w)
    if rng.random() < 0.15 and family in ("html", "latex", "markdown", "wiki"):
        amp = {"html": "&amp;", "latex": "\\&"}.get(family, "&")
        out += [amp, "more"]
        plain += ["&", "more"]
    return " ".join(out), " ".join(plain)


def generate(family: str, rng: random.Random) -> tuple[str, str, Counter]:
    """(text, suffix, pieces) of one generated document."""
    pieces: Counter = Counter()
    blocks: list[str] = []

    def sentence() -> str:
        s = " ".join([_word(rng).title(), *_words(rng, 3, 9)])
        return s + "."

    def trap() -> str:
        t = rng.choice(_TRAPS).format(_word(rng), _word(rng))
        if family == "html":
            t = html.escape(t, quote=False)
        if family == "latex":
            t = re.sub(r"([&%$#_])", r"\\\1", t.replace("C:\\drafts\\", "C:/").replace("~", "about"))
        return t

    def paragraph() -> str:
        parts = [_styled(sentence().split(), family, rng)[0] for _ in range(rng.randrange(1, 4))]
        if family != "markdown" or rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1) if family == "plain" else len(parts), trap())
        if family == "plain" or rng.random() < 0.2:
            parts = [trap(), *parts]
        if family != "plain" and rng.random() < 0.35:
            f = _formula(rng)
            pieces["formula", squeeze(f)] += 1
            inline = {
                "html": [rf'<span class="math">\({html.escape(f)}\)</span>'], "markdown": [f"${f}$"],
                "wiki": [f"<math>{f}</math>"], "latex": [f"${f}$", rf"\({f}\)"],
            }[family]
            parts.append(f"Here {rng.choice(inline)} holds.")
        return " ".join(parts)

    for _ in range(rng.choice([1, 1, rng.randrange(1, 4), rng.randrange(2, 9), rng.randrange(2, 9), rng.randrange(9, 30)])):
        kind = rng.choice(["p", "p", "p", "h", "h", "list", "code", "formula"]) if family != "plain" else "p"
        if kind == "p":
            p = paragraph()
            if family == "html":
                p = rng.choice([f"<p>{p}</p>", f"<div>{p}</div>", f'<p class="lead">{p}', f"<P>{p}</P>\n<!-- {_word(rng)} -->"])
            elif family == "wiki" and rng.random() < 0.3:
                p += rng.choice([f'<ref name="{_word(rng)}">{sentence()}</ref>', f"{{{{note|{_word(rng)}}}}}"])
            elif family == "latex" and rng.random() < 0.3:
                p += f"\n% {sentence()}"
            elif family == "markdown" and rng.random() < 0.2:
                p = "> " + p
            blocks.append(p)
        elif kind == "h":
            words = _words(rng, 3, 9)
            if rng.random() < 0.2:
                words = [str(rng.randrange(2, 99)), "ways", *words]
            if rng.random() < 0.7:
                words[0] = words[0].title()
            if rng.random() < 0.1:
                words[-1] += rng.choice("?!.")
            src, plain = _styled(words, family, rng)
            pieces["heading", plain] += 1
            level = rng.randrange(1, 4)
            if family == "html":
                t = rng.choice("hH") + str(level)
                blocks.append(rng.choice([f"<{t}>{src}</{t}>", f'<{t} id="s">\n  {src}\n</{t}>', f"<{t} class='t'>{src}</{t}>"]))
            elif family == "markdown":
                mark = "#" * level
                blocks.append(rng.choice([f"{mark} {src}", f"{mark} {src}", f"{mark} {src} {mark}", f"{src}\n{rng.choice('=-') * max(4, len(src) // 2)}", f"<h2>{plain.replace('&', '&amp;')}</h2>"]))
            elif family == "wiki":
                mark = "=" * (level + 1)
                blocks.append(rng.choice([f"{mark} {src} {mark}", f"{mark}{src}{mark}"]))
            else:
                name = "sub" * (level - 1) + "section" + rng.choice(["", "*"])
                blocks.append(f"\\{name}{{{src}}}")
        elif kind == "list":
            rows = [_words(rng, 2, 10) for _ in range(rng.randrange(1, 7))]
            for row in rows:
                if rng.random() < 0.2:
                    row[:0] = [str(rng.randrange(2, 99)), "ways"]
                if rng.random() < 0.6:
                    row[0] = row[0].title()
                if rng.random() < 0.1:
                    row[-1] += rng.choice("?!.")
            items = [_styled(row, family, rng) for row in rows]
            for _, plain in items:
                pieces["list_item", plain] += 1
            if family == "html":
                t = rng.choice(["ul", "ol"])
                end = rng.choice(["", "</li>"])
                blocks.append(f"<{t}>\n" + "\n".join(f"<li>{s}{end}" for s, _ in items) + f"\n</{t}>")
            elif family == "markdown":
                mark = rng.choice(["-", "*", "+", "1"])
                lines = []
                for i, (s, _) in enumerate(items):
                    if rng.random() < 0.15 and " " in s and "`" not in s and "[" not in s and "*" not in s:
                        a, b = s.rsplit(" ", 1)
                        s = f"{a}\n    {b}"
                    lines.append(f"{i + 1}. {s}" if mark == "1" else f"{mark} {s}")
                blocks.append("\n".join(lines))
            elif family == "wiki":
                mark = rng.choice("*#")
                blocks.append("\n".join(mark * (1 if i == 0 else rng.randrange(1, 3)) + rng.choice(["", " "]) + s for i, (s, _) in enumerate(items)))
            else:
                t = rng.choice(["itemize", "enumerate"])
                blocks.append(f"\\begin{{{t}}}\n" + "\n".join(f"  \\item {s}" for s, _ in items) + f"\n\\end{{{t}}}")
        elif kind == "code":
            c = _code(rng)
            pieces["code", squeeze(c)] += 1
            if family == "html":
                e = html.escape(c, quote=False)
                blocks.append(rng.choice([f"<pre>{e}</pre>", f"<pre><code>{e}</code></pre>", f'<PRE class="c">\n{e}\n</PRE>']))
            elif family == "markdown":
                f = rng.choice(["```", "~~~"])
                indented = "\n".join("    " + x for x in c.split("\n"))
                listed = bool(blocks) and re.match(r"\s*(?:[-*+]|\d+\.) ", blocks[-1].split("\n")[-1])
                blocks.append(f"{f}{rng.choice(['', 'python', 'sh'])}\n{c}\n{f}" if listed or rng.random() < 0.7 else indented)
            elif family == "wiki":
                blocks.append(rng.choice([f"<source>\n{c}\n</source>", f'<syntaxhighlight lang="sh">\n{c}\n</syntaxhighlight>', f"<pre>\n{c}\n</pre>"]))
            else:
                t = rng.choice(["verbatim", "lstlisting"])
                blocks.append(f"\\begin{{{t}}}\n{c}\n\\end{{{t}}}")
        else:
            f = _formula(rng)
            pieces["formula", squeeze(f)] += 1
            if family == "html":
                blocks.append(rf"<div>\[{html.escape(f)}\]</div>")
            elif family == "markdown":
                blocks.append(rng.choice([f"$${f}$$", f"$$\n{f}\n$$"]))
            elif family == "wiki":
                blocks.append(f"<math>{f}</math>")
            else:
                blocks.append(rng.choice([f"\\begin{{equation}}\n{f}\n\\end{{equation}}", f"\\[\n{f}\n\\]", f"$${f}$$"]))
    text = ("\n" if family == "html" else "\n\n").join(blocks)
    if family == "html" and rng.random() < 0.6:
        text = f"<html><head><style>p {{ margin: 0 }}</style><script>var a = 1;</script></head><body>\n{text}\n</body></html>"
    if family == "latex" and rng.random() < 0.5:
        text = f"\\documentclass{{article}}\n\\begin{{document}}\n{text}\n\\end{{document}}"
    own = {"html": "html", "markdown": "md", "wiki": "wiki", "latex": "tex", "plain": rng.choice(["txt", "txt", "md"])}[family]
    return text, rng.choice([*[own] * 6, *["txt"] * 2, *["md"] * 2, rng.choice(_SUFFIXES)]), pieces


class Model:
    """Trees for the family of a text and for the kinds of its nodes."""

    def __init__(self, texts: int = TRAIN_TEXTS, seed: int = 11) -> None:
        rng = random.Random(seed)
        roots, families, rows, labels = [], [], [], []
        for i in range(texts):
            family = FAMILIES[i % len(FAMILIES)]
            text, suffix, pieces = generate(family, rng)
            roots.append(root_features(text, suffix))
            families.append(family)
            if i % 7:
                continue
            left = Counter(pieces)
            nodes, x, _ = node_features(PARSERS[family if family != "plain" else rng.choice(FAMILIES)](text), family if family != "plain" else "markdown")
            for n, row in zip(nodes, x):
                kind = next((k for k in KINDS[1:5] if left[k, n.body] > 0 and _may_be(n, k)), "none")
                if kind != "none":
                    left[kind, n.body] -= 1
                elif n.marker == "drop":
                    kind = "drop"
                rows.append(row)
                labels.append(kind)
        x, xr = np.array(rows), np.array(roots)
        self.families = {f: Trees(rounds=50).fit(xr, np.array([float(g == f) for g in families])) for f in FAMILIES}
        self.kinds = {k: Trees(rounds=25).fit(x, np.array([float(g == k) for g in labels])) for k in KINDS}

    def family(self, texts: list[tuple[str, str]]) -> list[str]:
        if not texts:
            return []
        x = np.array([root_features(t, s) for t, s in texts])
        p = np.stack([self.families[f].raw(x) for f in FAMILIES])
        return [FAMILIES[i] for i in p.argmax(0)]

    def log_kinds(self, x: np.ndarray) -> np.ndarray:
        raw = np.stack([self.kinds[k].raw(x) for k in KINDS], axis=1)
        return -np.logaddexp(0, -raw) - np.logaddexp(0, raw).sum(1, keepdims=True) + np.logaddexp(0, raw)


def _may_be(node: Node, kind: str) -> bool:
    """Whether a generated piece of this kind can be this candidate."""
    return {
        "heading": node.marker in ("h", "atx", "hash", "setext", "wikihead", "section"),
        "list_item": node.marker in ("li", "wikilist", "item"),
        "code": node.marker in ("pre", "fence", "indent", "wikicode", "lead", "verbatim"),
        "formula": node.marker in ("formula", "display", "dollar", "environment"),
    }[kind]


@lru_cache(maxsize=2)
def model(texts: int = TRAIN_TEXTS) -> Model:
    return Model(texts)


def decode(nodes: list[Node], parents: list[int], scores: np.ndarray) -> list[str]:
    """The most probable labels of a tree that do not contradict each other.

    Three states come down from the ancestors: free, within a heading, sealed (within code,
    a formula or a dropped node).
    """
    n = len(nodes)
    children: list[list[int]] = [[] for _ in range(n)]
    for i, p in enumerate(parents):
        if p >= 0:
            children[p].append(i)
    allowed = [range(len(KINDS)), [KINDS.index(k) for k in ("none", "formula", "drop")], [KINDS.index("none")]]
    under = [2 if k in SEALED else 1 if k == "heading" else 0 for k in KINDS]
    best = np.zeros((n, 3))
    pick = np.zeros((n, 3), int)
    for i in range(n - 1, -1, -1):
        for state in range(3):
            top = -np.inf
            for k in allowed[state]:
                s = scores[i, k] + sum(best[c, max(state, under[k])] for c in children[i])
                if s > top:
                    top, pick[i, state] = s, k
            best[i, state] = top
    state = [0] * n
    out = []
    for i in range(n):
        k = pick[i, state[i]]
        out.append(KINDS[k])
        for c in children[i]:
            state[c] = max(state[i], under[k])
    return out


Labelled = tuple[list[Node], list[str], list[int]]


def labelled_trees(texts: list[tuple[str | None, str | None]], trees: Model) -> list[tuple[str, Labelled | None]]:
    """The family of each text (given with its path), and its tree's nodes with labels and parents; a text
    of no family has no tree."""
    out: list[tuple[str, Labelled | None]] = [("plain", None)] * len(texts)
    marked = [i for i, (t, _) in enumerate(texts) if t and family_candidates(t)]
    families = trees.family([(texts[i][0], suffix_of(texts[i][1])) for i in marked])
    parsed = []
    for i, family in zip(marked, families):
        if family != "plain":
            parsed.append((i, family, node_features(PARSERS[family](texts[i][0]), family)))
    if parsed:
        scores = trees.log_kinds(np.concatenate([x for _, _, (_, x, _) in parsed]))
        at = 0
        for i, family, (nodes, x, parents) in parsed:
            out[i] = family, (nodes, decode(nodes, parents, scores[at : at + len(x)]), parents)
            at += len(x)
    return out


def pieces_of(texts: list[tuple[str | None, str | None, str | None]], trees: Model) -> list[list[tuple[str, str]]]:
    """(kind, body) pieces of texts given with their titles and paths."""
    out: list[list[tuple[str, str]]] = []
    for (_, title, path), (family, tree) in zip(texts, labelled_trees([(t, p) for t, _, p in texts], trees)):
        found = [(k, n.body) for n, k in zip(tree[0], tree[1]) if k in KINDS[1:5] and n.body] if tree else []
        if title and title.strip():
            body = clean_title(title, family, suffix_of(path), trees)
            if body and body != squeeze(title):
                found.append(("title", body))
        out.append(list(dict.fromkeys(found)))
    return out


def clean_title(title: str, family: str, suffix: str, trees: Model) -> str:
    """Plain text of a title: markup of its text's family, else of the family its own traces show."""
    if family and family != "plain":
        body = clean_inline(title, family)
        if body != squeeze(title):
            return body
    if family_candidates(title):
        own = trees.family([(title, suffix)])[0]
        if own != "plain":
            return clean_inline(title, own)
    return squeeze(html.unescape(title)) if re.search(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]{2,8});", title) else squeeze(title)


def _block(kind: str, body: str) -> str:
    if kind == "code":
        return f"```\n{body}\n```"
    if kind == "formula":
        return f"$${body}$$"
    return {"heading": "# ", "list_item": "- "}.get(kind, "") + body


def clean_text(text: str | None, tree: Labelled | None) -> str:
    """Clean text: blocks parted by blank lines, headings as "# ", items as "- ", code in fences,
    formulas set apart between dollars; a text of no family as it is, a null text as "".

    An item is followed by what stands within it as pieces of their own.
    """
    if tree is None:
        return text or ""
    nodes, labels, parents = tree
    kinds = {id(n): k for n, k in zip(nodes, labels)}
    formulas = {n.body for n, k in zip(nodes, labels) if k == "formula"}
    listed: set[int] = set()  # what has items within
    for n, p in zip(reversed(nodes), reversed(parents)):
        if p >= 0 and (n.marker == "li" or id(n) in listed):
            listed.add(id(nodes[p]))
    out: list[str] = []
    run: list[str] = []

    def end_run() -> None:
        body, alone = html_run("".join(run))
        run.clear()
        if alone and formulas.issuperset(alone):
            out.extend(_block("formula", f) for f in alone)
        elif body:
            out.append(body)

    # Nodes and texts still to come (None: a text ends), with what shows or hides their texts already: an item,
    # a heading, a dropped node.
    todo: list[tuple[Node | str | None, str]] = [(nodes[0], "")]
    while todo:
        n, held = todo.pop()
        if n is None:
            end_run()
            continue
        if isinstance(n, str):
            if not held:
                run.append(n)
            continue
        k = kinds.get(id(n), "none")
        if n.flow is None:
            end_run()
            if n.body and k != "drop" and (k != "none" or n.marker in ("text", "block", "inline", "root", "quote", "hash")):
                out.append(_block(k, n.body))
            if not (k in SEALED or n.body and (k != "none" or n.marker == "text")):
                todo.extend((c, "") for c in reversed(n.children))
            continue
        within, apart = held, False
        if k == "drop":
            run.append(" ")
            continue
        if n.marker == "drop":
            within = "drop"
        elif n.marker == "formula" and k == "formula":
            if not held:
                run.append(f"\\({n.body}\\)")
            elif held == "drop":
                out.append(_block(k, n.body))
            continue
        elif n.marker in ("li", "h", "pre") and (held != "head" or n.marker == "h"):
            end_run()
            if n.body and (held != "drop" or k != "none"):
                out.append(_block(k, n.body))
            if n.marker == "pre" or k in SEALED:
                continue
            if held != "drop" or k != "none":
                within = "head" if n.marker == "h" else "item"
            apart = True
        elif held == "item" and (n.marker == "quote" or n.marker == "block" and id(n) in listed):
            within, apart = "", True
        elif not held and n.marker in ("block", "root", "quote"):
            apart = True
        if apart:
            end_run()
            todo.append((None, ""))
        todo.extend((c, within) for c in reversed(n.flow))
    end_run()
    return "\n\n".join(out)


def clean_document(text: str | None, path: str | None, trees: Model) -> str:
    return clean_text(text, labelled_trees([(text, path)], trees)[0][1])


def markup_pieces(documents: DataFrame) -> DataFrame:
    """``corpus_id, doc_seq, kind, body`` of the documents under drafts/, each piece once.

    Null and empty texts have no pieces but that of their title; null titles and titles
    without markup give none; empty bodies are no pieces.
    """
    trees = model()
    rows = in_folder(documents, "drafts").select(*KEY, "text", "title", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, batch.num_rows, 500):
                part = batch.slice(cut, 500)
                c, s, t, h, p = (x.to_pylist() for x in part.columns)
                found = pieces_of(list(zip(t, h, p)), trees)
                flat = [(c[i], s[i], k, b) for i, f in enumerate(found) for k, b in f]
                columns = list(zip(*flat)) if flat else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, y) for x, y in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))],
                    names=[*KEY, "kind", "body"],
                )

    return rows.mapInArrow(run, "corpus_id string, doc_seq int, kind string, body string").distinct()


def clean_drafts(documents: DataFrame) -> DataFrame:
    """``corpus_id, doc_seq, title, text`` of the documents under drafts/, clean, each once."""
    trees = model()
    rows = in_folder(documents, "drafts").select(*KEY, "text", "title", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, s, t, h, p = (x.to_pylist() for x in batch.columns)
            made = labelled_trees(list(zip(t, p)), trees)
            titles = [
                clean_title(x, family, suffix_of(y), trees) if x and x.strip() else x
                for x, y, (family, _) in zip(h, p, made)
            ]
            texts = [clean_text(x, tree) for x, (_, tree) in zip(t, made)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(titles, pa.string()), pa.array(texts, pa.string())],
                names=[*KEY, "title", "text"],
            )

    out = rows.mapInArrow(run, "corpus_id string, doc_seq int, title string, text string")
    return out.dropDuplicates(KEY)

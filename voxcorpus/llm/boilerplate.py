"""The main body of web pages whose text keeps one line for each block.

Method: tree scoring. A page is a tree of regions (what lies between sections of links),
sections (runs of lines between blank lines) and lines. A paragraph scores a point, one for each
comma and one for each hundred characters up to three, a line that is none a tenth of that. It
passes its points in full to its section and by half to its region, its parent and grandparent;
each container's score is what it was passed, less its link density. The region with the best
score is the container. Its sibling regions before it are kept (title, byline), those behind it
if they have ``SIBLING`` of its score and a paragraph; from the last paragraph on (or the region's
first section, where it has none) sections are kept up to the first that the frame opens. Lines dense in links are taken out of the body again.

The text has no links any more. What is left of them is repetition: the menus, notices,
prompts and footers of a site come back on its pages. The link density of a line is the
share of the site's pages that hold it (letters only, the site's own name aside), the share
over all sites where the site has few pages, and 1 for lines that are a row of links or a
trail. No cut of the site's statistics grows with its pages: a site has at most (lines of a
page / ``LEAST_SHARE``) such lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcorpus.llm.common import KEY, flat_map, salt_of, salted, salts, web_pages, website
from voxcorpus.llm.site_lines import letters

#: Least share of a site's pages for a line's repetition to count at all.
LEAST_SHARE = 0.08
#: Pages of a site that weigh as much as what is known of a line from all sites.
PRIOR_PAGES = 4.0
#: A line in so many of a site's pages is as good as a link.
DENSE = 0.45
#: ... and belongs to the frame wherever it stands.
FRAME = 0.6
#: Part of the best score a sibling behind the best container must have.
SIBLING = 0.1

_SEPARATED = re.compile(r"\s[|/·•→›»>–]\s|\s[|/·•→›»>–]$")
_SENTENCE = re.compile(r"[.!?…]+[\"”’»)]*(?=\s+\S)|[。！？](?=.)")
_END = re.compile(r"[.!?…。！？][\"”’»)]*\s*»?$")
_COMMA = re.compile(r"[,，、;；]")
_BULLET = re.compile(r"^\s*(?:[-–•*·▪]|\d+[.)])\s+")
_PREFIX = r"^\s*([^:：]{2,24}?)\s*[:：]"
_PREFIXED = re.compile(_PREFIX)
_PIECES = re.compile(r"\s[|/·•→›»>]\s")
_WIDE = re.compile("[぀-ヿ㐀-䶿一-鿿가-힣]")
_COMMENT = re.compile(r"^[^\W\d_][\w-]*\s?[:：]\s")
_CUT = re.compile(r"…\s*»?[.!]?$")


def _brand(site: Column) -> Column:
    """Letters of the label before the last dot of a host; a character no text has if they are under four."""
    label = F.regexp_replace(F.coalesce(F.element_at(F.split(site, r"\."), -2), F.lit("")), r"[^\p{L}]+", "")
    return F.when(F.length(label) >= 4, label).otherwise("\x00")


def _prefix_letters(line: Column) -> Column:
    """Letters of what stands before the first colon of a line, "" without one."""
    colon = line.contains(":") | line.contains("：")
    return F.when(colon, letters(F.regexp_extract(line, _PREFIX, 1))).otherwise("")


def _hash(found: Column, brand: Column, *kind: str) -> Column:
    """Hash of letters with the site's own name masked; null for none."""
    return F.when(found != "", F.xxhash64(*map(F.lit, kind), F.replace(found, brand, F.lit("§"))))


def hashed_pages(documents: DataFrame) -> DataFrame:
    """``corpus_id, doc_seq, text, title, site, salt, hashes, prefixes`` of the pages with a text, exchanged by (site,
    salt): the hashes of a page's lines and of what stands before a colon in them; the site as a hash too.

    The texts are read once, their lines hashed once, and this one exchange serves the counts and the decision.
    The salt is a page's, so a site of a third of all pages is spread over as many tasks as there are cores.
    """
    named = (
        web_pages(documents)
        .where(F.col("text").isNotNull())
        .select(
            *KEY, "text", "title", website(F.col("path")).alias("name"), F.split("text", "\n").alias("lines"),
            salt_of(salts(documents), *KEY).alias("salt"),
        )
    )
    found = named.select(
        *KEY, "text", "title", "salt", F.xxhash64("name").alias("site"), _brand(F.col("name")).alias("brand"),
        F.transform("lines", letters).alias("wholes"), F.transform("lines", _prefix_letters).alias("befores"),
    )
    return found.select(
        *KEY, "text", "title", "site", "salt",
        F.transform("wholes", lambda x: _hash(x, F.col("brand"))).alias("hashes"),
        F.transform("befores", lambda x: _hash(x, F.col("brand"), "prefix")).alias("prefixes"),
    ).repartition("site", "salt")


def repetition(pages: DataFrame, n_salts: int) -> DataFrame:
    """``site, shares``: for each site the hashes of its repeated lines with their shares, of ``hashed_pages``.

    Of a site with few pages the shares are drawn to those over all sites.
    """
    # each page's hashes once, however often it was delivered; its own row under the hash 0 counts the pages.
    # Text and title are named so that all readers of the exchange need the same columns.
    whole = F.length("text") >= F.coalesce(F.length("title") * 0, F.lit(0))
    hashes = F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), F.when(whole, F.col("hashes")), F.col("prefixes")))
    each = pages.select("site", "salt", *KEY, F.explode(hashes).alias("h")).where(F.col("h").isNotNull()).distinct()
    parts = each.groupBy("site", "salt", "h").agg(F.count(F.lit(1)).alias("df"))
    # ``line`` is the hash again, told apart behind the aggregation so that both its readers share it
    by_site = parts.groupBy("site", "h").agg(F.sum("df").alias("df"), F.max("h").alias("line"))
    total = by_site.groupBy("site").agg(F.max(F.when(F.col("line") == 0, F.col("df"))).alias("n"))
    # a site of a third of all pages has as many of the lines: they meet its one total in parts
    lines = by_site.where("line <> 0").select("site", "h", "df", salt_of(n_salts, "line").alias("salt"))
    counted = lines.join(salted(total, n_salts), ["site", "salt"]).drop("salt")
    overall = counted.groupBy("h").agg(
        (F.sum("df") / F.sum("n")).alias("overall"), F.count(F.lit(1)).alias("sites")
    )
    # A hash of one or two sites has nothing to learn from the others: only shared ones are joined.
    shared = overall.where(F.col("sites") >= 3)
    prior = F.coalesce("overall", F.lit(0.0))
    share = (F.col("df") + PRIOR_PAGES * prior) / (F.col("n") + PRIOR_PAGES)
    return (
        counted.join(shared, "h", "left")
        .where((F.col("df") >= 2) | F.col("overall").isNotNull())
        .select("site", "h", share.cast("float").alias("share"))
        .where(F.col("share") >= LEAST_SHARE)
        .groupBy("site")
        .agg(F.collect_list(F.struct("h", "share")).alias("shares"))
    )


class Page:
    """One page as sections of scored lines."""

    def __init__(self, lines: list[str], share: list[float], prefix: list[float], title: str | None) -> None:
        self.lines = [" ".join(x.split()) for x in lines]
        self.share = share
        self.prefix = prefix
        self.title = re.sub(r"\W+", "", (title or "").casefold())
        self._titled: dict[int, bool] = {}
        self.sections: list[list[int]] = []
        now: list[int] = []
        for i, x in enumerate(self.lines):
            if x:
                now.append(i)
            elif now:
                self.sections.append(now)
                now = []
        if now:
            self.sections.append(now)
        self.density = [self._density(i) for i in range(len(lines))]
        self.breaks = [0 if s >= 0.2 else len(_SENTENCE.findall(x)) for s, x in zip(share, self.lines)]
        self.paragraphs = [self._paragraph(i) for i in range(len(lines))]

    def _row_of_links(self, i: int) -> bool:
        """Several short pieces between separators, without a sentence's end."""
        x = self.lines[i]
        if not _SEPARATED.search(x):
            return False
        pieces = [p for p in _PIECES.split(x) if p.strip()]
        return len(pieces) >= 3 and max(map(len, pieces)) < 90 or len(pieces) >= 2 and bool(
            self.title and re.sub(r"\W+", "", pieces[-1].casefold()) == self.title
        )

    def _density(self, i: int) -> float:
        if not self.lines[i]:
            return 0.0
        if self.share[i] >= FRAME:
            return min(1.0, self.share[i])
        return 1.0 if self._row_of_links(i) else self.share[i]

    def points(self, i: int) -> float:
        """Points a line passes on to its section: in full if it is a paragraph, a tenth if it is not."""
        x = self.lines[i]
        if self.density[i] >= DENSE:
            return 0.0
        whole = 1 + len(_COMMA.findall(x)) + min(3.0, len(x) / 100)
        return (whole if self.paragraph(i) else whole / 10) * (1 - min(1.0, self.density[i] / DENSE))

    def paragraph(self, i: int) -> bool:
        return self.paragraphs[i]

    def _paragraph(self, i: int) -> bool:
        """Running text of its own: more than one sentence that does not come back on the site; not
        somebody's comment ("Name: ...") or a teaser cut short."""
        x = self.lines[i]
        if not self.breaks[i] or self.share[i] >= 0.2 or _CUT.search(x) or _BULLET.match(x) or _COMMENT.match(x):
            return False
        return True

    def dense(self, section: list[int]) -> bool:
        """A section of links: no paragraph, not the page's title, and most of its lines are links; of one
        or two lines all must be of the frame."""
        if any(self.paragraph(i) or self.titled(i) for i in section):
            return False
        least = FRAME if len(section) <= 2 else DENSE
        return sum(self.density[i] >= least for i in section) > 0.5 * len(section)

    def closes(self, section: list[int]) -> bool:
        """A section that the frame begins with behind the body: it opens with a line of the frame, or
        with the heading of a list of links."""
        first = section[0]
        if any(self.paragraph(i) for i in section):
            return False
        some = any(self.density[i] >= DENSE for i in section)
        heading = len(section) > 1 and not _END.search(self.lines[first])
        return self.density[first] >= DENSE or (some or heading) and self.share[first] >= 0.2

    def titled(self, i: int) -> bool:
        """Whether a line is the page's title, marks and letter case aside."""
        if i not in self._titled:
            self._titled[i] = bool(self.title) and re.sub(r"\W+", "", self.lines[i].casefold()) == self.title
        return self._titled[i]

    def _leads(self, i: int) -> bool:
        """"Next: ...": a short prefix that comes back on the site, and a title behind it."""
        x = self.lines[i]
        if self.prefix[i] < LEAST_SHARE or _BULLET.match(x) or _END.search(x):
            return False
        m = _PREFIXED.match(x)
        if not m:
            return False
        most = 14 if m[1].isascii() or not _WIDE.search(m[1]) else 8
        return len(m[1]) <= most and len(x.split()) <= 24

    def link_density(self, section: list[int]) -> float:
        """Share of a container's lines that are links."""
        return sum(self.density[i] >= DENSE for i in section) / len(section)

    def body(self) -> set[int]:
        """The lines of the body."""
        s = self.sections
        if not s:
            return set()
        passed = [sum(map(self.points, x)) for x in s]
        regions: list[list[int]] = [[]]
        for k, x in enumerate(s):
            if self.dense(x):
                regions.append([])
            else:
                regions[-1].append(k)
        regions = [r for r in regions if r] or [list(range(len(s)))]
        as_parent = [p * (1 - self.link_density(x)) for p, x in zip(passed, s)]
        as_grandparent = [sum(passed[k] for k in r) / 2 * (1 - self.link_density([i for k in r for i in s[k]])) for r in regions]
        scores = [max(g, max(as_parent[k] for k in r)) for g, r in zip(as_grandparent, regions)]
        best = max(range(len(scores)), key=scores.__getitem__)
        has_paragraph = [any(self.paragraph(i) for i in x) for x in s]
        behind = [
            r for r, score in zip(regions[best + 1 :], scores[best + 1 :])
            if score >= SIBLING * scores[best] and any(has_paragraph[k] for k in r)
        ]
        last_region = behind[-1] if behind else regions[best]
        last = max((k for k in last_region if has_paragraph[k]), default=last_region[0])
        end = last + 1
        while end < len(s) and not self.closes(s[end]):
            end += 1
        inside = [i for x in s[regions[0][0] : end] for i in x]
        return set(inside) - self.frame_within(inside)

    def frame_within(self, inside: list[int]) -> set[int]:
        """Lines of the frame within the body: prompts, counters, links to other posts."""
        out: set[int] = set()
        for k, i in enumerate(inside):
            if k == 0 and not self._row_of_links(i):
                continue  # the title
            if k == 1 and not self.paragraph(inside[0]) and (self.titled(inside[0]) or self.share[i] < 0.75) and not self._row_of_links(i):
                continue  # the byline
            before = k > 0 and inside[k - 1] in out
            last = k >= len(inside) - 2  # a closing sentence and the note on the series
            if self.density[i] >= (FRAME if last and not before else DENSE):
                out.add(i)
            elif self._leads(i) and (before or self.prefix[i] >= 0.15):
                out.add(i)
        return out


def frame_lines(text: str, title: str | None, hashes: list, prefixes: list, shares: dict[int, float]) -> list[int]:
    """Numbers (from 1) of the visible lines that are not of the body."""
    lines = text.split("\n")
    known = lambda hs: [shares.get(h, 0.0) if h is not None else 0.0 for h in hs] + [0.0] * (len(lines) - len(hs))
    share, prefix = known(hashes), known(prefixes)
    page = Page(lines, share, prefix, title)
    body = page.body()
    return [i + 1 for i, x in enumerate(page.lines) if x and i not in body]


def _pages_with_shares(documents: DataFrame) -> DataFrame:
    """Pages with the hashes of their lines and the shares of their site."""
    pages = hashed_pages(documents)
    n = salts(documents)
    shares = salted(repetition(pages, n), n)
    return pages.join(shares, ["site", "salt"], "left").select(
        *KEY,
        "text",
        "title",
        "hashes",
        "prefixes",
        F.col("shares.h").alias("known"),
        F.col("shares.share").alias("share"),
    )


def page_frames(documents: DataFrame) -> DataFrame:
    """``corpus_id, doc_seq, line_no`` of the visible lines that are not of the body of their page, each
    once. Null, empty and blank texts have no lines."""

    def make():
        def one(corpus, seq, text, title, hashes, prefixes, known, share):
            shares = dict(zip(known, share)) if known else {}
            return ((corpus, seq, n) for n in frame_lines(text, title, hashes, prefixes, shares))

        return one

    return flat_map(_pages_with_shares(documents), make, "corpus_id string, doc_seq int, line_no int").distinct()


def page_bodies(documents: DataFrame) -> DataFrame:
    """``corpus_id, doc_seq, text``: each page's body, its lines joined by line feeds."""

    def make():
        def one(corpus, seq, text, title, hashes, prefixes, known, share):
            shares = dict(zip(known, share)) if known else {}
            drop = set(frame_lines(text, title, hashes, prefixes, shares))
            kept = [x for n, x in enumerate(text.split("\n"), 1) if n not in drop]
            yield corpus, seq, re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()

        return one

    return flat_map(_pages_with_shares(documents), make, "corpus_id string, doc_seq int, text string").dropDuplicates(KEY)

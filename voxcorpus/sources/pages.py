"""Web pages: content, links, and a crawl over any fetcher."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
import heapq
import re
import time
import urllib.error
from urllib.parse import urljoin, urlparse
import urllib.request
from urllib.robotparser import RobotFileParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcorpus.functions import html as H
from voxcorpus.functions import lists as L
from voxcorpus.functions import url as U
from voxcorpus.functions.rows import running

_HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*["']?([^"'\s>]+)"""


def page_documents(pages: DataFrame) -> DataFrame:
    """``page_id, path, title, text`` of the pages with enough content.

    Null and empty pages, and those of an error status, have none.
    """
    rows = pages.where(F.col("html").isNotNull() & (F.length("html") >= L.MIN_PAGE_CHARS))
    if "status_code" in pages.columns:
        rows = rows.where(F.coalesce("status_code", F.lit(200)) < 400)
    made = rows.select("page_id", U.path(F.col("url")).alias("path"), H.page_content_column(F.col("html")).alias("c"))
    return made.where(F.col("c.text").isNotNull()).select("page_id", "path", "c.title", "c.text")


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, position, link``: the links of each page to pages of its own host that a crawl would
    follow, each at its first position."""
    base = pages.where(F.col("html").isNotNull()).select("page_id", "url", U.host(F.col("url")).alias("host"), "html")
    found = base.select(
        "page_id", "url", "host", F.posexplode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("position", "href")
    )
    # exploding one link keeps the expression that resolves it from being repeated wherever the link is used
    link = F.explode(F.array(U.resolve(F.col("href"), F.col("url"))))
    links = found.select("page_id", "position", "host", link.alias("link"))
    own = (F.col("link") != "") & (U.host(F.col("link")) == F.col("host"))
    kept = links.where(own & ~U.should_skip(U.path(F.col("link"))))
    return kept.groupBy("page_id", "link").agg(F.min("position").alias("position")).select("page_id", "position", "link")


@dataclass
class Fetched:
    status: int
    content_type: str
    body: str


Fetcher = Callable[[str], Fetched]


def normalize_url(link: str, base: str) -> str:
    p = urlparse(urljoin(base, link))
    return f"{p.scheme}://{p.netloc.lower()}{p.path or '/'}" if p.scheme and p.netloc else ""


def should_skip(path: str) -> bool:
    low = path.lower()
    return low.startswith(L.SKIP_PREFIXES) or low.endswith(L.SKIP_EXTENSIONS)


def priority(path: str) -> int:
    p = path.lower().rstrip("/")
    for least, pattern in ((10, "$"), (8, "/about(?:/|$)"), (6, "/(?:blog|posts)$"), (5, "/(?:blog|posts)/")):
        if re.match(pattern, p):
            return least
    return 4 if re.match("/(?:services|pricing|work|portfolio|case-studies)(?:/|$)", p) else 2


class TableFetcher:
    """Pages of one host out of a table. Addresses a crawl is about to fetch are looked up together, in one job
    for all of them, and kept until they are asked for."""

    def __init__(self, pages: DataFrame, host: str) -> None:
        own = pages.where(U.host(F.col("url")) == host.lower())
        self.own = own.select(U.normalize(F.col("url")).alias("u"), "html", "status_code").persist()
        self.held: dict[str, Fetched] = {}

    def prefetch(self, urls: list[str]) -> None:
        wanted = [u for u in urls if u not in self.held]
        if not wanted:
            return
        first = self.own.where(F.col("u").isin(wanted)).groupBy("u").agg(F.min_by(F.struct("html", "status_code"), F.coalesce("status_code", F.lit(200))).alias("p"))
        for r in first.collect():
            self.held[r["u"]] = Fetched(r["p"]["status_code"] or 200, "text/html", r["p"]["html"] or "")
        for u in wanted:
            self.held.setdefault(u, Fetched(404, "text/html", ""))

    def __call__(self, url: str) -> Fetched:
        self.prefetch([url])
        return self.held[url]


def table_fetcher(pages: DataFrame, host: str) -> Fetcher:
    return TableFetcher(pages, host)


def http_fetcher(agent: str = "voxcorpus", timeout: float = 10.0, most_bytes: int = 20_000_000) -> Fetcher:
    """Pages over HTTP: redirects are followed, an error status is an answer, no answer within the time limit an
    exception. Of a body no more than ``most_bytes`` is taken."""

    def fetch(url: str) -> Fetched:
        request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept": "text/html,*/*;q=0.5"})
        try:
            answer = urllib.request.urlopen(request, timeout=timeout)
        except urllib.error.HTTPError as e:
            return Fetched(e.code, e.headers.get("Content-Type", ""), "")
        with answer:
            charset = answer.headers.get_content_charset() or "utf-8"
            body = answer.read(most_bytes)
            try:
                text = body.decode(charset, "replace")
            except LookupError:
                text = body.decode("utf-8", "replace")
            return Fetched(answer.status, answer.headers.get("Content-Type", "text/html"), text)

    return fetch


def crawl(
    spark: SparkSession, start: str, fetch: Fetcher, max_pages: int = 20, delay: float = 0.0, agent: str = "voxcorpus", corpus_id: str = "site"
) -> DataFrame:
    """Same-origin crawl by priority: ``corpus_id, doc_seq, path, title, text``.

    max_pages bounds attempts: skipped, forbidden and failed addresses count.
    """
    root = normalize_url(start, start)
    docs: list[tuple] = []
    if root:
        origin = urlparse(root)
        robots = RobotFileParser()
        try:
            answer = fetch(f"{origin.scheme}://{origin.netloc}/robots.txt")
            robots.parse(answer.body.splitlines() if answer.status < 400 else [])
        except Exception:  # noqa: BLE001  no answer is no restriction
            robots.parse([])
        queue, known, visited, n = [(-priority(origin.path), 0, root)], {root}, 0, 0
        while queue and visited < max_pages:
            if hasattr(fetch, "prefetch"):  # those that come next as far as is known, in one look-up
                fetch.prefetch([u for _, _, u in heapq.nsmallest(max_pages - visited, queue)])
            _, _, url = heapq.heappop(queue)
            visited += 1
            path = urlparse(url).path or "/"
            if should_skip(path) or not robots.can_fetch(agent, url):
                continue
            try:
                answer = fetch(url)
            except Exception:  # noqa: BLE001  a page that can't be fetched is skipped
                continue
            finally:
                time.sleep(delay)
            if answer.status >= 400 or "html" not in answer.content_type.lower():
                continue
            content = H.page_content(answer.body)
            if content:
                docs.append((corpus_id, len(docs) + 1, path, *content))
            for a in (e for e in H.parse(answer.body).elements() if e.tag == "a" and e.attrs.get("href")):
                link = normalize_url(a.attrs["href"], url)
                p = urlparse(link)
                if link and p.netloc == origin.netloc and not should_skip(p.path) and link not in known:
                    known.add(link)
                    n += 1
                    heapq.heappush(queue, (-priority(p.path), n, link))
    return spark.createDataFrame(docs, "corpus_id string, doc_seq int, path string, title string, text string")


def crawl_order(pages: DataFrame) -> DataFrame:
    """``host, page_id, link, priority, place``: in which order a crawl that knows all pages of a host
    would fetch them."""
    rows = pages.where(F.col("url").isNotNull()).select(
        U.host(F.col("url")).alias("host"), "page_id", U.normalize(F.col("url")).alias("link"), U.priority(U.path(F.col("url"))).alias("priority")
    )
    rows = rows.where((F.col("link") != "") & ~U.should_skip(U.path(F.col("link"))))
    once = rows.groupBy("host", "link").agg(F.min("page_id").alias("page_id"), F.max("priority").alias("priority"))
    placed = running(once, ["host"], [-F.col("priority")], "page_id", F.lit(1), "earlier")
    return placed.select("host", "page_id", "link", "priority", (F.col("earlier") + 1).cast("int").alias("place"))

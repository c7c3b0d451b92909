"""Column functions over absolute addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxcorpus.functions import lists as L

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#;]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def path(url: Column) -> Column:
    """Path of an address, "/" if it has none."""
    p = F.regexp_extract(url, _PARTS, 3)
    return F.when(p == "", "/").otherwise(p)


def normalize(url: Column) -> Column:
    """Without query, fragment and parameters, the host in lower case; "" if there is no scheme or host."""
    scheme = F.lower(F.regexp_extract(url, _PARTS, 1))
    return F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit("://"), host(url), path(url)))


def without_dots(path: Column, squeeze: bool = False) -> Column:
    """A path with its ``.`` and ``..`` segments resolved; squeeze: without empty ones between others."""
    segments = F.slice(F.split(path, "/"), 2, 1 << 30)
    last = F.element_at(segments, -1)
    inner = F.filter(segments, lambda x, i: (x != "") | (i == F.size(segments) - 1)) if squeeze else segments
    joined = F.aggregate(
        F.filter(inner, lambda x: x != "."),
        F.lit(""),
        lambda done, x: F.when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x)),
    )
    full = F.when(last.isin(".", ".."), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(full == "", "/").otherwise(full)


def resolve(href: Column, base: Column) -> Column:
    """Normalized address of a link on a page: absolute, from the host's root, or beside the page, where dot
    segments are resolved."""
    scheme = F.regexp_extract(base, _PARTS, 1)
    root = F.concat(scheme, F.lit("://"), host(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    href = F.trim(href)
    bare = F.regexp_extract(href, "^[^?#;]*", 0)
    full = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(bare == "", base)
        .when(href.startswith("/"), F.concat(root, without_dots(bare)))
        .otherwise(F.concat(root, without_dots(F.concat(folder, bare), squeeze=True)))
    )
    return normalize(full)


def should_skip(url_path: Column) -> Column:
    low = F.lower(url_path)
    prefixes = "|".join(map(re.escape, L.SKIP_PREFIXES))
    suffixes = "|".join(map(re.escape, L.SKIP_EXTENSIONS))
    return low.rlike(f"^(?:{prefixes})|(?:{suffixes})$")


def priority(url_path: Column) -> Column:
    """How soon a crawl fetches a path: the root first, then about, posts, offers."""
    p = F.regexp_replace(F.lower(url_path), "/+$", "")
    return (
        F.when(p == "", 10)
        .when(p.rlike(r"^/about(?:/|$)"), 8)
        .when(p.isin("/blog", "/posts"), 6)
        .when(p.rlike("^/(?:blog|posts)/"), 5)
        .when(p.rlike("^/(?:services|pricing|work|portfolio|case-studies)(?:/|$)"), 4)
        .otherwise(2)
    )

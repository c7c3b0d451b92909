"""Documents that hold passages of held-out evaluation items.

Method: prefix-filtered set join on shingles (five words). A leak holds ``RUN`` words of an item in a
row, or a stretch of ``STRETCH`` words or more of which single ones, one in ``ONE_IN``, are others. Of
an item's shingles, ordered by rarity, the commonest are left out as long as every leak must keep one
of the others (``necessary``): a run keeps all nine shingles of its 13 words; a stretch of L words with
k = L // 7 others keeps at least L - k - 4 (k + 1), so each window of L may miss one fewer than that,
for every L. The rest are joined. A hit fixes the item and the offset of document against item
(positional bound), item and document must leave room for a leak there (length bound); the item-sized
window of the document at that offset is then compared word by word, which is exact.

Items are the small side: their texts go to the tasks in blocks of at most ``BLOCK_ITEMS`` items
and ``BLOCK_CHARS`` characters, as many blocks as there must be, and each worker builds a block's index
once. Documents are never shuffled and pairs of documents never formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
import re
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcorpus.llm.common import spread

SHINGLE = 5
RUN = 13
STRETCH = 30
ONE_IN = 7
BLOCK_ITEMS = 100_000
BLOCK_CHARS = 64_000_000

_MARKS = re.compile(r"[^\w\s–—―]+|_+")
_DASHES = re.compile(r"[–—―]")
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], dtype="uint64")


def words(text: str | None) -> list[str]:
    """Words parted by blanks or dashes, without letter case and marks."""
    return _DASHES.sub(" ", _MARKS.sub("", (text or "").casefold())).split()


def shingle_hashes(ids: np.ndarray) -> np.ndarray:
    """Hash of the shingle that begins at each position; the last four wrap round into padding."""
    padded = np.concatenate([ids, np.zeros(SHINGLE - 1, ids.dtype)]).astype("uint64")
    out = np.zeros(len(ids), "uint64")
    for k in range(SHINGLE):
        out += (padded[k : k + len(ids)] + np.uint64(1)) * _POWERS[k]
    return out ^ (out >> np.uint64(29))


def leaked(same: np.ndarray) -> bool:
    """Whether matches at one offset hold RUN in a row, or STRETCH with single words replaced."""
    run = best = 0
    for s in same:
        run = run + 1 if s else 0
        best = max(best, run)
    if best >= RUN:
        return True
    if len(same) < STRETCH or same.sum() * ONE_IN < STRETCH * (ONE_IN - 1):
        return False
    twice = np.nonzero(~same[:-1] & ~same[1:])[0]
    edges = [0, *(twice + 1), len(same)]
    for lo, hi in zip(edges, edges[1:]):
        if hi - lo < STRETCH:
            continue
        off = np.concatenate([[0], np.cumsum(~same[lo:hi])])
        at = np.nonzero(same[lo:hi])[0]
        for i in at:
            ends = at[at >= i + STRETCH - 1]
            if len(ends) and ((off[ends + 1] - off[i]) * ONE_IN <= ends - i + 1).any():
                return True
    return False


@lru_cache(maxsize=4096)
def least_kept(words: int) -> int:
    """Shingles a stretch of so many words keeps at least."""
    k = words // ONE_IN
    return words - k - (SHINGLE - 1) * (k + 1)


def necessary(counts: np.ndarray) -> np.ndarray:
    """Which of an item's shingles must be joined, given how often each occurs in all items. The commonest
    shared ones are left out one by one, where no run and no stretch could then be missed."""
    m = len(counts)
    kept = np.ones(m, bool)
    left = np.zeros(m + 1, int)  # left[i]: shingles left out before position i
    run = RUN - SHINGLE + 1
    lengths = np.arange(STRETCH, m + SHINGLE)
    spare = np.array([least_kept(int(x)) - 1 for x in lengths])
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] < 2:
            break
        trial = left.copy()
        trial[i + 1 :] += 1
        lo, hi = max(0, i - run + 1), min(i, m - run)
        bad = any(trial[b + run] - trial[b] == run for b in range(lo, hi + 1))
        if not bad:
            for x, most in zip(lengths, spare):
                size = x - SHINGLE + 1
                begin = np.arange(max(0, i - size + 1), min(i, m - size) + 1)
                if len(begin) and (trial[begin + size] - trial[begin]).max() > most:
                    bad = True
                    break
        if not bad:
            kept[i], left = False, trial
    return kept


class Index:
    """Shingles of a block of items: sorted hashes and, as arrays, where they stand. Items of one text are one."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        numbers: dict[tuple[str, ...], list[int]] = {}
        for n, text in items:
            numbers.setdefault(tuple(words(text)), []).append(n)
        numbers = {t: n for t, n in numbers.items() if len(t) >= RUN}
        self.numbers = list(numbers.values())
        self.vocabulary: dict[str, int] = {}
        for t in numbers:
            for w in t:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.ids = [np.array([self.vocabulary[w] for w in t], "int64") for t in numbers]
        each = [shingle_hashes(i)[: len(i) - SHINGLE + 1] for i in self.ids]
        flat = np.concatenate([*each, np.zeros(0, "uint64")])
        item = np.repeat(np.arange(len(each)), [len(h) for h in each])
        at = np.concatenate([np.arange(len(h)) for h in each] + [np.zeros(0, int)])
        _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
        often = count[place] if len(flat) else np.zeros(0, int)
        ends = np.cumsum([0] + [len(h) for h in each])
        kept = np.concatenate([necessary(often[x:y]) if often[x:y].max(initial=0) > 1 else np.ones(y - x, bool) for x, y in zip(ends, ends[1:])] + [np.zeros(0, bool)])
        flat, item, at = flat[kept], item[kept], at[kept]
        order = np.argsort(flat, kind="stable")
        self.item, self.at = item[order].astype("int32"), at[order].astype("int32")
        self.shingles, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)

    def search(self, documents: list[str | None]) -> list[tuple[int, int]]:
        """(position of the document, item number) of all leaks."""
        get = self.vocabulary.get
        texts = [[get(w, 0) for w in words(t)] for t in documents]
        sizes = np.array([len(t) for t in texts], "int64")
        starts = np.concatenate([[0], np.cumsum(sizes + SHINGLE)])
        flat = np.zeros(starts[-1], "int64")
        for s, t in zip(starts, texts):
            flat[s : s + len(t)] = t
        if not len(flat) or not len(self.shingles):
            return []
        h = shingle_hashes(flat)
        place = np.searchsorted(self.shingles, h)
        place[place == len(self.shingles)] = 0
        hits = np.nonzero(self.shingles[place] == h)[0]
        if not len(hits):
            return []
        # every posting of every hit, as (document, item, offset), each once
        n = self.count[place[hits]]
        posting = np.repeat(self.first[place[hits]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        doc = np.repeat(np.searchsorted(starts, hits, side="right") - 1, n)
        item = self.item[posting].astype("int64")
        offset = np.repeat(hits, n) - starts[doc] - self.at[posting]
        long = np.array([len(i) for i in self.ids])
        room = np.minimum(long[item], sizes[doc] - offset) - np.maximum(0, -offset)
        found: set[tuple[int, int]] = set()
        for d, i, o in np.unique(np.stack([doc, item, offset], 1)[room >= RUN], axis=0).tolist():
            if (d, i) in found:
                continue
            ids = self.ids[i]
            lo, hi = max(0, -o), min(len(ids), len(texts[d]) - o)
            begin = int(starts[d]) + o
            if leaked(ids[lo:hi] == flat[begin + lo : begin + hi]):
                found.add((d, i))
        return sorted((d, number) for d, i in found for number in self.numbers[i])


#: The last index a worker built, so that its next task has it.
_built: dict[str, Index] = {}


def _index_of(key: str, texts) -> Index:
    if key not in _built:
        _built.clear()
        _built[key] = Index(texts.value)
    return _built[key]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    items = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        yield sorted((r[0], r[1]) for r in mine.collect())


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id``: each pair once.

    Null and short texts leak nothing, items under RUN words can't be leaked; an item
    that stands there under two numbers is found under both. No items: no rows.
    """
    out = None
    docs = spread(documents.where(F.col("text").isNotNull()).select("doc_id", "text"), "doc_id")
    for block in _blocks(items):
        texts = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], key=uuid4().hex, texts=texts) -> Iterator[pa.RecordBatch]:
            index = _index_of(key, texts)
            for batch in batches:
                for cut in range(0, batch.num_rows, 1000):
                    part = batch.slice(cut, 1000)
                    found = index.search(part.column(1).to_pylist())
                    ids = part.column(0).to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[d] for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())],
                        names=["doc_id", "item_id"],
                    )

        part = docs.mapInArrow(run, "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, suite, documents``: of each item in how many documents it leaks, 0 included."""
    n = find_leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "suite").join(n, "item_id", "left").fillna(0, ["documents"])

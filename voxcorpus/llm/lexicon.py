"""Words of scripts without blanks between them, learned from a collection.

All texts are counted: every piece of up to ``LONGEST`` characters of a run, how often it stands
right before a sure end of a sentence and how often right behind one. A piece is a word if it
holds together (wherever it is parted, one part mostly goes on with the other) and is not mostly
part of one longer piece. What a word says about a gap is the log of how much oftener than average it
stands at a sure end. Tasks count in dictionaries and hand on partial sums, so no piece is hot.

The model holds at most ``MOST_WORDS`` pieces of each script, the commonest ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of the longest piece.
LONGEST = 5
#: Pieces a script's model holds, and how often one must stand in the collection.
MOST_WORDS = 30_000
LEAST_COUNT = 5
#: A task hands on its counts when it holds so many pieces.
MOST_PIECES = 500_000
#: Least product of how often a word's two parts go on with each other, at every place it can be parted.
COHESION = 0.15
#: Places an unseen word is thought to have been seen at, at the average rate.
SMOOTHING = 10.0

# The scripts, as ranges of code points.
SCRIPTS = {
    "thai": "฀-๿", "lao": "຀-໿", "burmese": "က-႟", "khmer": "ក-៿",
    "cjk": "々-〇ぁ-ヿ㐀-䶿一-鿿豈-﫿",
}
_RUN = re.compile("|".join(f"(?P<{k}>[{v}]+)" for k, v in SCRIPTS.items()))
_ANY = "[" + "".join(SCRIPTS.values()) + "]"
#: Marks, digits of the scripts and repetition signs are no words.
_NO_WORD = re.compile("[๐-๙໐-໙၀-၏។-៚០-៩・]")
#: What parts sentences for sure: full stops of the scripts, question and exclamation marks, paragraphs.
_SURE = re.compile("[。！？!?។៕။][\"'”’」』）)]*\\s*|\\n[^\\S\\n]*\\n\\s*")


def pieces(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(script, piece, 1 if right before a sure end, 1 if right behind one) of all places of a text."""
    ends, begins = {len(text.rstrip())}, {len(text) - len(text.lstrip())}
    for m in _SURE.finditer(text):
        ends.add(m.start())
        begins.add(m.end())
    for m in _RUN.finditer(text):
        script, a = m.lastgroup, m.start()
        run = m.group()
        for part in _NO_WORD.split(run) if _NO_WORD.search(run) else (run,):
            a = text.index(part, a) if part != run else a
            n = len(part)
            closes, opens = a + n in ends, a in begins
            for i in range(n):
                for size in range(1, min(LONGEST, n - i) + 1):
                    yield script, part[i : i + size], int(closes and i + size == n), int(opens and i == 0)
            a += n


def count_pieces(texts: DataFrame) -> DataFrame:
    """``script, piece, n, ends, begins`` of a table with the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys, sums = list(seen), list(seen.values())
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                    *(pa.array([s[i] for s in sums], pa.int64()) for i in range(3)),
                ],
                names=["script", "piece", "n", "ends", "begins"],
            )
            seen.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for script, piece, closes, opens in pieces(text):
                    got = seen.get((script, piece))
                    if got is None:
                        seen[script, piece] = [1, closes, opens]
                    else:
                        got[0] += 1
                        got[1] += closes
                        got[2] += opens
                if len(seen) >= MOST_PIECES:
                    yield flush()
        if seen:
            yield flush()

    rows = texts.select("text").where(F.col("text").rlike(_ANY))
    counted = rows.mapInArrow(run, "script string, piece string, n bigint, ends bigint, begins bigint")
    return counted.groupBy("script", "piece").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("begins").alias("begins"))


@dataclass
class Lexicon:
    """Costs of the known words, and what they say about the gap behind or before them."""

    costs: dict[str, float]
    closing: dict[str, float]
    opening: dict[str, float]

    def words(self, text: str) -> list[str]:
        """The cheapest path through the lattice of a run; unknown characters stay together."""
        n = len(text)
        cost = [0.0] + [math.inf] * n
        back = [0] * (n + 1)
        get = self.costs.get
        for i in range(n):
            here = cost[i]
            if here + 1.2 < cost[i + 1]:
                cost[i + 1], back[i + 1] = here + 1.2, i
            for size in range(1, min(LONGEST, n - i) + 1):
                c = get(text[i : i + size])
                if c is not None and here + c < cost[i + size]:
                    cost[i + size], back[i + size] = here + c, i
        out: list[str] = []
        unknown, at = "", n
        while at:
            word = text[back[at] : at]
            if word in self.costs:
                if unknown:
                    out.append(unknown)
                    unknown = ""
                out.append(word)
            else:
                unknown = word + unknown
            at = back[at]
        if unknown:
            out.append(unknown)
        return out[::-1]


def build(rows: list[tuple[str, str, int, int, int]]) -> Lexicon:
    """A lexicon of counted pieces (script, piece, n, ends, begins)."""
    made = Lexicon({}, {}, {})
    for script in {r[0] for r in rows}:
        mine = {p: (n, e, b) for s, p, n, e, b in rows if s == script}
        total = sum(n for p, (n, _, _) in mine.items() if len(p) == 1) or 1
        within: dict[str, int] = {}  # the commonest longer piece that holds a piece
        for p, (n, _, _) in mine.items():
            for q in (p[1:], p[:-1]) if len(p) > 1 else ():
                within[q] = max(within.get(q, 0), n)
        rates = [sum(x[k] for p, x in mine.items() if len(p) == 1) / total for k in (1, 2)]
        for p, (n, e, b) in mine.items():
            if len(p) > 1:
                parts = [(mine[p[:i]][0], mine[p[i:]][0]) for i in range(1, len(p)) if p[:i] in mine and p[i:] in mine]
                if not parts or within.get(p, 0) > 0.9 * n or min(n * n / (x * y) for x, y in parts) < COHESION:
                    continue
            made.costs[p] = 1.0 + 0.02 * math.log(total / n)
            for rate, count, weights in ((rates[0], e, made.closing), (rates[1], b, made.opening)):
                if rate:
                    weights[p] = math.log((count + SMOOTHING * rate) / (n + SMOOTHING) / rate)
    return made


def learn(texts: DataFrame) -> Lexicon | None:
    """The lexicon of all texts of a table with the column ``text``; None if no text has such a script."""
    w = Window.partitionBy("script").orderBy(F.desc("n"), "piece")  # cut to MOST_WORDS in every task first
    top = count_pieces(texts).where(F.col("n") >= LEAST_COUNT).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MOST_WORDS)
    rows = [tuple(r) for r in top.select("script", "piece", "n", "ends", "begins").collect()]
    return build(rows) if rows else None

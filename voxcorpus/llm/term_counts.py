"""How often, and in how many records, every distinct term occurs.

Method: last-seen counters. Rows are hash-partitioned by record and ordered by it, so
that all deliveries of one record follow each other in one task. A term keeps three
numbers (occurrences, records, number of the last record that held it) and no set of
records: a record is counted when the term's last record is another one. As each record
lies in one task as a whole, the tasks' counters are partial sums; only they are
shuffled by term, so a term that stands in every record moves one row for each task.
"""

from __future__ import annotations

from collections.abc import Iterator
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest matches of the word pattern in lower-cased text.
WORD = r"[a-z][a-z'\-]+"
#: A task hands on its counters when it holds so many terms, and starts anew at the next record.
MOST_TERMS = 1_000_000
RARE_RECORDS = 2
COMMON_SHARE = 0.15


def _counters(pattern: str | None, most_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall if pattern else lambda s: (s,)
        seen: dict[str, list[int]] = {}
        records, last_key = 0, None

        def flush(n: int) -> pa.RecordBatch:
            terms = [*seen, None]
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array(terms, pa.string()),
                    pa.array([*(c[0] for c in seen.values()), 0], pa.int64()),
                    pa.array([*(c[1] for c in seen.values()), n], pa.int64()),
                ],
                names=["term", "occurrences", "records"],
            )
            seen.clear()
            return made

        done = 0
        for batch in batches:
            *keys, values = (c.to_pylist() for c in batch.columns)
            for key, value in zip(zip(*keys), values):
                if key == last_key:
                    continue
                last_key = key
                if len(seen) >= most_terms:
                    yield flush(records - done)
                    done = records
                records += 1
                if value is None:
                    continue
                for term in find(value.lower() if pattern else value):
                    c = seen.get(term)
                    if c is None:
                        seen[term] = [1, 1, records]
                    else:
                        c[0] += 1
                        if c[2] != records:
                            c[1] += 1
                            c[2] = records
        yield flush(records - done)

    return run


def count_terms(
    df: DataFrame,
    record: list[str],
    value: Column,
    order: Column | None = None,
    pattern: str | None = WORD,
    most_terms: int = MOST_TERMS,
) -> DataFrame:
    """``term, occurrences, records`` of all records; the row whose term is null holds the
    number of records.

    df: may hold a record several times; the delivery that is first by ``order`` counts.
    value: a text, cut into terms by ``pattern``; or one term where pattern is None. A null
    value is a record without terms. Empty input gives the row (null, 0, 0) or no row.
    """
    rows = df.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(record)],
        value.cast("string").alias("v"),
        (order if order is not None else F.lit(0)).alias("o"),
    )
    keys = [f"k{i}" for i in range(len(record))]
    parts = (
        rows.repartition(*keys)
        .sortWithinPartitions(*keys, F.col("o").asc_nulls_last(), F.col("v").asc_nulls_last())
        .select(*keys, "v")
        .mapInArrow(
            _counters(pattern, most_terms), "term string, occurrences bigint, records bigint"
        )
    )
    return parts.groupBy("term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")
    )


def mark_terms(
    counts: DataFrame, rare: int = RARE_RECORDS, common: float = COMMON_SHARE
) -> DataFrame:
    """Adds ``mark``: ``rare`` (at most ``rare`` records), ``common`` (more than the share
    ``common`` of all records) or null; a term that is both is ``rare``."""
    # The row of the total is the one without occurrences. Told apart by that, and not by its null term, both
    # readers of the counts ask for the same aggregation, which is computed once.
    total = counts.agg(F.max(F.when(F.col("occurrences") == 0, F.col("records"))).alias("total"))
    terms = counts.where(F.col("occurrences") > 0).withColumn("one", F.lit(0))
    joined = terms.join(F.broadcast(total.withColumn("one", F.lit(0))), "one")
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common) * F.col("total"), "common")
    return joined.select("term", "occurrences", "records", mark.alias("mark"))


def text_terms(documents: DataFrame) -> DataFrame:
    """Terms of all documents with a text, whatever their path."""
    rows = documents.where(F.col("text").isNotNull())
    return mark_terms(
        count_terms(rows, ["corpus_id", "doc_seq"], F.col("text"), F.col("loaded_at"))
    )


def brand_count_terms(words: DataFrame) -> DataFrame:
    """Values of brand_count; records are the keys, those with a null count included."""
    return mark_terms(
        count_terms(
            words,
            ["corpus_id", "token"],
            F.col("brand_count").cast("bigint"),
            F.col("computed_at"),
            pattern=None,
        )
    )

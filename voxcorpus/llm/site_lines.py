"""Lines that come back page after page on one website.

Method: hash the normalized lines, count the distinct documents of each site and hash,
keep the hashes over the threshold, join back, rebuild the documents without them.

Each text is read and each line normalized once: the lines' 64-bit hashes and keys are
exchanged by (hash, salt), and both the counts and the join back use that one exchange. The
salt is a document's, so the distinct documents of the parts of a hash add up, and a line that
stands on a third of all pages is spread over as many tasks as there are cores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcorpus.llm.common import KEY, join_on, salt_of, salted, salts, web_pages, website

LEAST_DOCUMENTS = 6


def letters(line: Column) -> Column:
    """The letters of a line (category L) in order, letter case aside."""
    return F.replace(
        F.lower(F.regexp_replace(line, r"[^\p{L}]+", "")), F.lit("ß"), F.lit("ss")
    )


def hashed_lines(documents: DataFrame) -> DataFrame:
    """``corpus_id, doc_seq, line_no, h`` of each line with letters of a website page."""
    lines = web_pages(documents).select(
        *KEY,
        website(F.col("path")).alias("site"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    )
    return (
        lines.select(*KEY, "site", (F.col("pos") + 1).alias("line_no"), letters(F.col("line")).alias("l"))
        .where(F.col("l") != "")
        .select(*KEY, "line_no", F.xxhash64("site", "l").alias("h"))
    )


def repeated_lines(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``corpus_id, doc_seq, line_no, documents``: each repeated line of each page once.

    Null texts and paths have no lines; lines without letters are never repeated lines; a
    page delivered twice counts as one document.
    """
    n = salts(documents)
    lines = hashed_lines(documents).withColumn("salt", salt_of(n, *KEY)).repartition("h", "salt")
    # A hash within a salt lies in one task: its documents are counted there, only counts move. The least line
    # number is kept (and true of all) so that both readers of the exchange need the same columns of it.
    once = lines.groupBy("h", "salt", *KEY).agg(F.min("line_no").alias("first")).where("first > 0")
    parts = once.groupBy("h", "salt").agg(F.count(F.lit(1)).alias("documents"))
    often = parts.groupBy("h").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= least)
    found = lines.join(salted(often, n), ["h", "salt"])
    return found.select("h", "salt", *KEY, "line_no", "documents").distinct().select(*KEY, "line_no", "documents")


def without_repeated_lines(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``corpus_id, doc_seq, text, removed``: each page without its repeated lines.

    Pages without any keep their text; a page of repeated lines only keeps "".
    """
    drop = (
        repeated_lines(documents, least)
        .groupBy(*KEY)
        .agg(F.collect_set("line_no").alias("drop"))
    )
    pages = web_pages(documents).where(F.col("text").isNotNull())
    once = pages.groupBy(*KEY).agg(F.min_by("text", F.struct(F.col("loaded_at").isNull(), "loaded_at", "text")).alias("text"))
    kept = F.filter(
        F.split("text", "\n"),
        lambda line, i: ~F.array_contains(F.coalesce("drop", F.array().cast("array<int>")), i + 1),
    )
    return join_on(once, drop, KEY, "left").select(
        *KEY,
        F.array_join(kept, "\n").alias("text"),
        F.coalesce(F.size("drop"), F.lit(0)).alias("removed"),
    )

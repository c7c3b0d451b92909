"""Queries of the training-text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcorpus.llm import boilerplate, encoding, leaks, markup, mixing, quality, sentences, site_lines, term_counts
from voxcorpus.llm.common import KEY, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# 1: sentence boundaries across languages and scripts


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, d, "documents_in"))


@query
def p1_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents_in"))


# 2: page boilerplate mixed with main content


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.page_frames(table(spark, d, "documents_in"))


@query
def p2_bodies(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.page_bodies(table(spark, d, "documents_in"))


# 3: per-document text quality statistics


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.junk_documents(table(spark, d, "documents_in"))


@query
def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents_in"))


# 4: lines repeated across one site's documents


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, d, "documents_in")).select(*KEY, "line_no")


@query
def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.without_repeated_lines(table(spark, d, "documents_in"))


_SITE_LINES = """
WITH pages AS (
  SELECT corpus_id, doc_seq, min_by(text, loaded_at) AS text,
         regexp_replace(lower(split_part(min(path), '/', 1)), '^www\\.', '') AS site
  FROM documents_in
  WHERE split_part(path, '/', 1) LIKE '%.%' AND text IS NOT NULL
  GROUP BY corpus_id, doc_seq
), lines AS (
  SELECT corpus_id, doc_seq, site, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM pages
), lettered AS (
  SELECT *, replace(lower(regexp_replace(line, '[^\\p{L}]+', '', 'g')), 'ß', 'ss') AS l FROM lines
), often AS (
  SELECT site, l FROM lettered WHERE l <> ''
  GROUP BY site, l HAVING count(DISTINCT (corpus_id, doc_seq)) >= 6
)
"""
SQL["p4_found"] = (
    _SITE_LINES
    + "SELECT DISTINCT corpus_id, doc_seq, CAST(line_no AS INTEGER) AS line_no FROM lettered JOIN often USING (site, l)"
)

# 5: frequency of every distinct value or term


def _fields(spark: SparkSession, d: str) -> DataFrame:
    text = term_counts.text_terms(table(spark, d, "documents_in"))
    count = term_counts.brand_count_terms(table(spark, d, "signature_words"))
    return text.withColumn("field_name", F.lit("text")).unionByName(
        count.withColumn("field_name", F.lit("brand_count"))
    )


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


@query
def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).select("field_name", "term", "occurrences", "records", "mark")


_TERMS = """
WITH docs AS (
  SELECT corpus_id, doc_seq, min_by(text, loaded_at) AS text
  FROM documents_in WHERE text IS NOT NULL GROUP BY corpus_id, doc_seq
), words AS (
  SELECT corpus_id, doc_seq, unnest(regexp_extract_all(lower(text), '[a-z][a-z''\\-]+')) AS term FROM docs
), keys AS (
  SELECT corpus_id, token, min_by(brand_count, computed_at) AS n FROM signature_words GROUP BY corpus_id, token
), counted AS (
  SELECT 'text' AS field_name, term, count(*) AS occurrences, count(DISTINCT (corpus_id, doc_seq)) AS records,
         (SELECT count(*) FROM docs) AS total
  FROM words GROUP BY term
  UNION ALL
  SELECT 'brand_count', CAST(n AS VARCHAR), count(*), count(*), (SELECT count(*) FROM keys)
  FROM keys WHERE n IS NOT NULL GROUP BY n
), marked AS (
  SELECT field_name, term, occurrences, records,
         CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.15 * total THEN 'common' END AS mark
  FROM counted
)
"""
SQL["p5_found"] = _TERMS + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL"
SQL["p5_terms"] = _TERMS + "SELECT field_name, term, occurrences, records, mark FROM marked"

# 6: markup residue in text documents


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_pieces(table(spark, d, "documents_in"))


@query
def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_drafts(table(spark, d, "documents_in"))


# 7: evaluation texts leaking into training text


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


# 8: mixing sources to target weights


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.unreachable_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


@query
def p8_copies(spark: SparkSession, d: str) -> DataFrame:
    rates, _ = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixing.copies(rates)


SQL["p8_found"] = """
WITH docs AS (SELECT lower(trim(source)) AS source, n_tokens FROM documents)
SELECT t.source FROM mix_targets t
LEFT JOIN (SELECT source, sum(n_tokens) AS n FROM docs GROUP BY source) s USING (source)
WHERE coalesce(n, 0) * max_repeats < target_share * (SELECT sum(n_tokens) FROM docs)
"""

# 9: garbled text from wrong character encoding


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_documents(table(spark, d, "documents"))


@query
def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored_documents(table(spark, d, "documents"))

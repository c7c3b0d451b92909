"""Queries of the parts of the pipeline that come after the measures, and the same in SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcorpus.functions import lists as L
from voxcorpus.functions.rows import beside
from voxcorpus.operators import cadence as C
from voxcorpus.operators import clusters as K
from voxcorpus.operators import tone as N
from voxcorpus.operators import vectors as V
from voxcorpus.operators import vocabulary as W
from voxcorpus.plans import queries as Q
from voxcorpus.plans.fingerprint import fingerprint
from voxcorpus.plans.queries import BY, query, rounded
from voxcorpus.sources.tables import baseline, cadence_runs, corpus

_NOISE = f"(contains(token, '''') OR token IN ({Q._quoted(L.URL_NOISE)}) OR length(token) < 4)"


@query(f"""WITH ranked_words AS ({Q._SIGNATURE}), shown AS (
  SELECT corpus_id, token, row_number() OVER (PARTITION BY corpus_id ORDER BY rank) AS place FROM ranked_words WHERE NOT {_NOISE}
) SELECT corpus_id, token, CAST(place AS INTEGER) AS place FROM shown WHERE place <= 15""")
def signature_shown(spark: SparkSession, d: str) -> DataFrame:
    rates = W.brand_rates(Q._counts(corpus(spark, d)), BY)
    return W.shown_signature(W.signature_words(rates, baseline(spark, d), BY), BY)


@query(Q._TOKENS + """, base AS (
  SELECT count(*) AS n, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS t FROM baseline_in WHERE rnk <= 20000 AND token IS NOT NULL
) SELECT corpus_id, count(*) AS brand_unique_tokens, CAST(sum(brand_count) AS BIGINT) AS brand_total_tokens,
       (SELECT n FROM base) AS baseline_unique_tokens, (SELECT t FROM base) AS baseline_total_tokens FROM counts GROUP BY corpus_id""")
def vocabulary_stats(spark: SparkSession, d: str) -> DataFrame:
    return W.vocabulary_stats(W.token_counts(corpus(spark, d), BY), baseline(spark, d), BY)


_PIECES = """pieces AS (
  SELECT corpus_id, doc_seq, list_filter(list_transform(string_split(regexp_replace(text, '([.!?][.!?"”’'')\\]]*)\\s+', '\\1' || chr(30), 'g'), chr(30)),
         lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS p FROM docs
), sentences AS (SELECT corpus_id, doc_seq, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS sent_seq, unnest(p) AS sentence FROM pieces)"""


@query(f"WITH {Q._DOCS}, {_PIECES}, {Q._MEASURED} SELECT corpus_id, doc_seq, sent_seq, CAST(n_words AS INTEGER) AS n_words FROM kept")
def sentence_lengths(spark: SparkSession, d: str) -> DataFrame:
    return C.sentence_lengths(C.measure_sentences(C.split_sentences(corpus(spark, d), BY)), BY)


def _sql_line(label: str, signal: str, *limits) -> str:
    name, factor, digits, unit = L.SHOWN_MEASURES[signal]
    shown = f"printf('%.{digits}f', {signal} * {factor})"
    return f"CASE WHEN {Q._sql_fires(signal, *limits)} = 1 THEN '{label}: {name} ' || {shown} || '{unit}, {N.bounds(*limits)}' END"


def _sql_lines_of(column: str, most: int) -> str:
    cases = " ".join(
        f"WHEN '{label}' THEN list_filter([{', '.join(_sql_line(label, *t) for t in triggers)}], lambda x: x IS NOT NULL)[1:{most}]"
        for label, triggers in L.TONE_RULES
    )
    return f"(CASE {column} {cases} ELSE CAST([] AS VARCHAR[]) END)"


@query(f"""WITH {Q._RUNS}, {Q._SCORES}, long AS ({Q._LONG}),
placed AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, run_no ORDER BY s DESC, i) AS place FROM long),
pairs AS (SELECT a.corpus_id, a.run_no, a.label, a.s, b.label AS label2, b.s AS s2, coalesce(a.sentence_count, 0) = 0 OR coalesce(a.word_count, 0) = 0 AS nothing
  FROM placed a JOIN placed b ON a.corpus_id = b.corpus_id AND a.run_no = b.run_no AND a.place = 1 AND b.place = 2
), named AS (
  SELECT f.*, p.nothing, p.s AS top, p.label, CASE WHEN p.s2 >= 0.5 AND p.s2 >= p.s - 0.25 THEN p.label2 END AS second
  FROM flat f JOIN pairs p ON f.corpus_id = p.corpus_id AND f.run_no = p.run_no
) SELECT corpus_id, run_no, array_to_string(CASE WHEN nothing THEN ['empty input'] WHEN top = 0 THEN ['no tone triggers fired']
    ELSE {_sql_lines_of('label', 3)} || {_sql_lines_of('second', 2)} END, ' | ') AS rationale FROM named""")
def tone_rationale(spark: SparkSession, d: str) -> DataFrame:
    return N.classify(cadence_runs(spark, d)).select("corpus_id", "run_no", F.array_join("rationale", " | ").alias("rationale"))


_FIGURES = ["sentence_count", "word_count", *C.MEASURES]


@query(f"""WITH docs0 AS (SELECT corpus_id, doc_seq, min_by(text, loaded_at) AS text FROM documents_in GROUP BY corpus_id, doc_seq),
docs AS (SELECT 'c' AS corpus_id, doc_seq, text FROM docs0),
{Q._sentences()}, {Q._MEASURED}, {Q._CADENCE}, {Q._WORDS}, {Q._CONTENT}, {Q._COUNTS}, figures AS (
  {" UNION ALL ".join(f"SELECT '{m}' AS name, CAST({m} AS DOUBLE) AS value FROM cadence" for m in _FIGURES)}
) SELECT name, round(value, 6) AS value FROM figures
UNION ALL SELECT 'doc_count', CAST(count(*) AS DOUBLE) FROM docs
UNION ALL SELECT 'thin_corpus', CASE WHEN word_count < 3000 THEN 1.0 ELSE 0.0 END FROM cadence
UNION ALL SELECT 'brand_total_tokens', CAST(sum(brand_count) AS DOUBLE) FROM counts
UNION ALL SELECT 'brand_unique_tokens', CAST(count(*) AS DOUBLE) FROM counts
UNION ALL SELECT 'baseline_unique_tokens', CAST(count(*) AS DOUBLE) FROM baseline_in
UNION ALL SELECT 'baseline_total_tokens', CAST(sum(cnt) AS DOUBLE) FROM baseline_in
UNION ALL SELECT 'min_brand_count', CAST(3 AS DOUBLE) UNION ALL SELECT 'semantic_filter_applied', CAST(1 AS DOUBLE)
UNION ALL SELECT 'vocab_size', CAST(count(*) AS DOUBLE) FROM counts WHERE brand_count >= 3 AND NOT {_NOISE}""")
def fingerprint_whole(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline (cadence, voice, clusters, avoided words, tone) over all documents as one corpus; the
    figures in it that do not hang on an embedder."""
    # a number is taken once in each corpus; of all documents as one, each needs its own
    docs = corpus(spark, d).withColumn("doc_seq", F.xxhash64("corpus_id", "doc_seq"))
    f = fingerprint(spark, docs, baseline(spark, d), "all", "documents_in", exact=False, lengths=False)
    figures = {m: f["cadence"][m] for m in _FIGURES}
    figures |= {k: f[k] for k in ("doc_count", "thin_corpus", "brand_total_tokens")} | f["stats"] | {"vocab_size": f["clusters"]["vocab_size"]}
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in figures.items()], "name string, value double"), "value")


@query("SELECT count(*) AS vectors, CAST(6 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS strays FROM embeddings WHERE embedding IS NOT NULL")
def kmeans_fixed_point(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors lie nearer to the mean of another cluster than to that of their own: none, when the runs have
    come to rest."""
    rows = V.with_unit(K.kmeans(Q._vectors(spark, d)), "embedding", "v").select("cluster", "v", vector_to_array("v").alias("a")).persist()
    middle = rows.groupBy("cluster").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"))
    few = middle.agg(F.collect_list(F.struct("cluster", "m")).alias("ms"))
    # the nearest mean m of a is that of the largest a.m - |m|^2 / 2
    score = F.transform("ms", lambda c: F.struct((V.dot(F.col("a"), c["m"]) - V.dot(c["m"], c["m"]) / 2).alias("s"), c["cluster"].alias("cluster")))
    placed = beside(rows.select("cluster", "a"), few).withColumn("near", F.array_max(score)["cluster"])
    return placed.agg(
        F.count(F.lit(1)).alias("vectors"), F.count_distinct("cluster").alias("clusters"),
        F.sum(F.when(F.col("near") == F.col("cluster"), 0).otherwise(1)).alias("strays"),
    )

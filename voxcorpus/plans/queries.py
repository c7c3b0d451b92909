"""The driver's queries of the core operators, each over whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcorpus.functions import lists as L
from voxcorpus.functions import text as T
from voxcorpus.functions import url as U
from voxcorpus.operators import cadence as C
from voxcorpus.operators import clusters as K
from voxcorpus.operators import tone as N
from voxcorpus.operators import vectors as V
from voxcorpus.operators import vocabulary as W
from voxcorpus.plans.fingerprint import sketch
from voxcorpus.sources import pages as P
from voxcorpus.sources.folder import documents_of_files
from voxcorpus.sources.tables import baseline, cadence_runs, corpus, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BY = ["corpus_id"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _counts(docs: DataFrame) -> DataFrame:
    """Token counts, kept: the rates read them twice, and they are small against the texts."""
    return W.token_counts(docs, BY).persist()


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# Parts of the SQL

_DOCS = """docs AS (
  SELECT corpus_id, doc_seq, min_by(path, loaded_at) AS path, min_by(title, loaded_at) AS title,
         min_by(text, loaded_at) AS text
  FROM documents_in GROUP BY corpus_id, doc_seq
)"""
_WORDS = """words AS (
  SELECT corpus_id, doc_seq, unnest(regexp_extract_all(lower(text), '[a-z][a-z''\\-]+')) AS token FROM docs
)"""
_CONTENT = f"""content AS (
  SELECT * FROM words WHERE length(token) >= 3 AND token NOT IN ({_quoted(L.STOPWORDS)})
)"""
_COUNTS = "counts AS (SELECT corpus_id, token, count(*) AS brand_count FROM content GROUP BY corpus_id, token)"
_RATES = """rates AS (
  SELECT corpus_id, token, brand_count, brand_count * 1e6 / sum(brand_count) OVER (PARTITION BY corpus_id) AS brand_rate FROM counts
)"""
_TOKENS = f"WITH {_DOCS}, {_WORDS}, {_CONTENT}, {_COUNTS}, {_RATES}"
_CUT = """unnest(string_split(regexp_replace(text, '([.!?][.!?"”’'')\\]]*)\\s+', '\\1' || chr(30), 'g'), chr(30)))"""


def _sentences(source: str = "docs") -> str:
    return f"""cut AS (
  SELECT corpus_id, doc_seq, regexp_replace({_CUT}, '^\\s+|\\s+$', '', 'g') AS sentence FROM {source}
), sentences AS (SELECT * FROM cut WHERE sentence <> '')"""


def _count_of(forms) -> str:
    return f"len(list_filter(regexp_extract_all(lower(parted), '[\\p{{L}}\\p{{N}}]+'), lambda w: w IN ({_quoted(forms)})))"


_WORD = "'[^\\s\\p{P}]+(?:[.,:]\\d+)*'"
_MEASURED = f"""parted AS (
  SELECT *, regexp_replace(sentence, '([\\p{{L}}\\p{{N}}])[''’]([A-Za-z])', '\\1 \\2', 'g') AS parted FROM sentences
), measured AS (
  SELECT *, len(regexp_extract_all(parted, {_WORD})) AS n_words,
         len(regexp_extract_all(regexp_replace(parted, {_WORD}, 'w', 'g'), '\\.\\.+|--+|\\p{{P}}')) AS n_marks,
         {_count_of(L.FIRST_PERSON)} AS n_first, {_count_of(L.SECOND_PERSON)} AS n_second
  FROM parted
), kept AS (SELECT * FROM measured WHERE n_words > 0)"""
_CADENCE = """cadence AS (
  SELECT g.corpus_id, coalesce(count(n_words), 0) AS sentence_count, CAST(coalesce(sum(n_words), 0) AS BIGINT) AS word_count,
         coalesce(avg(n_words), 0.0) AS mean_length, coalesce(stddev_pop(n_words), 0.0) AS std_length,
         coalesce(CAST(quantile_cont(n_words, 0.25) AS DOUBLE), 0.0) AS p25_length,
         coalesce(CAST(quantile_cont(n_words, 0.5) AS DOUBLE), 0.0) AS p50_length,
         coalesce(CAST(quantile_cont(n_words, 0.75) AS DOUBLE), 0.0) AS p75_length,
         coalesce(sum(n_first) / CAST(sum(n_words) AS DOUBLE), 0.0) AS pronoun_ratio_first,
         coalesce(sum(n_second) / CAST(sum(n_words) AS DOUBLE), 0.0) AS pronoun_ratio_second,
         coalesce(sum(n_marks) * 100.0 / CAST(sum(n_words) AS DOUBLE), 0.0) AS punct_density,
         coalesce(avg(CASE WHEN n_words IS NULL THEN NULL WHEN rtrim(sentence) LIKE '%?' THEN 1.0 ELSE 0.0 END), 0.0) AS question_rate,
         coalesce(avg(CASE WHEN n_words IS NULL THEN NULL WHEN rtrim(sentence) LIKE '%!' THEN 1.0 ELSE 0.0 END), 0.0) AS exclamation_rate,
         coalesce(avg(CASE WHEN n_words IS NULL THEN NULL WHEN n_words < 5 THEN 1.0 ELSE 0.0 END), 0.0) AS fragment_rate
  FROM (SELECT DISTINCT corpus_id FROM docs) g LEFT JOIN kept k ON g.corpus_id = k.corpus_id
  GROUP BY g.corpus_id
)"""
_CADENCE_OF = f"WITH {_DOCS}, {_sentences()}, {_MEASURED}, {_CADENCE}"
_JOINED = "joined AS (SELECT corpus_id, 0 AS doc_seq, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_seq) AS text FROM docs GROUP BY corpus_id)"
_EXACT_OF = f"WITH {_DOCS}, {_JOINED}, {_sentences('joined')}, {_MEASURED}, {_CADENCE}"
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in C.MEASURES)

# Vocabulary


@query(f"WITH {_DOCS}, {_WORDS} SELECT corpus_id, doc_seq, token, count(*) AS n FROM words GROUP BY ALL")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    return W.tokens(corpus(spark, d), BY, content=False).groupBy(*BY, "doc_seq", "token").agg(F.count(F.lit(1)).alias("n"))


@query(_TOKENS + " SELECT corpus_id, token, brand_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY brand_count DESC, token) AS rank FROM counts) WHERE rank <= 30")
def top_vocab(spark: SparkSession, d: str) -> DataFrame:
    return W.top_vocabulary(W.token_counts(corpus(spark, d), BY), BY)


@query(_TOKENS + " SELECT corpus_id, token, brand_count, round(brand_rate, 6) AS brand_rate FROM rates")
def brand_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(W.brand_rates(_counts(corpus(spark, d)), BY), "brand_rate")


@query(_TOKENS + """, base AS (SELECT token, count(*) AS cnt FROM content GROUP BY token), ranked AS (
  SELECT token, cnt, cnt * 1e6 / (SELECT sum(cnt) FROM base) AS rate, row_number() OVER (ORDER BY cnt DESC, token) AS rnk FROM base
) SELECT token, cnt, round(rate, 6) AS rate, rnk FROM ranked WHERE rnk <= 20000""")
def baseline_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(W.baseline_from(corpus(spark, d)), "rate")


_SIGNATURE = _TOKENS + """, base AS (
  SELECT token, coalesce(cnt, 0) AS cnt, coalesce(rate, 0.0) AS baseline_rate, rnk FROM baseline_in WHERE rnk <= 20000 AND token IS NOT NULL
), scored AS (
  SELECT r.corpus_id, r.token, brand_rate, coalesce(baseline_rate, 0.0) AS baseline_rate, brand_count,
         brand_rate / (coalesce(baseline_rate, 0.0) + 1.0) AS ratio
  FROM rates r LEFT JOIN base b ON r.token = b.token
  WHERE brand_count >= 3 AND (coalesce(cnt, 0) >= 5 OR brand_count >= 5)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY round(ratio, 6) DESC, token) AS rank FROM scored)
SELECT corpus_id, token, round(brand_rate, 6) AS brand_rate, round(baseline_rate, 6) AS baseline_rate, round(ratio, 6) AS ratio, brand_count, rank
FROM ranked WHERE rank <= 25"""


@query(_SIGNATURE)
def signature_words(spark: SparkSession, d: str) -> DataFrame:
    rates = W.brand_rates(_counts(corpus(spark, d)), BY)
    return rounded(W.signature_words(rates, baseline(spark, d), BY), "brand_rate", "baseline_rate", "ratio")


@query(_TOKENS + f""", pool AS (
  SELECT token, coalesce(rate, 0.0) AS baseline_rate, row_number() OVER (ORDER BY coalesce(rate, 0.0) DESC, rnk, token) AS place
  FROM baseline_in WHERE rnk <= 20000 AND token IS NOT NULL
), wide AS (
  SELECT corpus_id, token, baseline_rate FROM (SELECT DISTINCT corpus_id FROM docs), pool
  WHERE place <= 500 AND token NOT IN ({_quoted(L.GENERIC_NOISE)})
), scored AS (
  SELECT w.corpus_id, w.token, coalesce(brand_rate, 0.0) AS brand_rate, baseline_rate, coalesce(brand_count, 0) AS brand_count,
         coalesce(brand_rate, 0.0) / (baseline_rate + 1e-6) AS ratio, baseline_rate / (coalesce(brand_rate, 0.0) + 1.0) AS suppression
  FROM wide w LEFT JOIN rates r ON w.corpus_id = r.corpus_id AND w.token = r.token
  WHERE coalesce(brand_count, 0) < 3
), ranked AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY round(suppression, 6) DESC, token) AS rank FROM scored)
SELECT corpus_id, token, round(brand_rate, 6) AS brand_rate, round(baseline_rate, 6) AS baseline_rate, round(ratio, 6) AS ratio,
       round(suppression, 6) AS suppression, brand_count, rank FROM ranked WHERE rank <= 25""")
def forbidden_candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    rates = W.brand_rates(_counts(docs), BY)
    out = W.forbidden_candidates(rates, baseline(spark, d), docs, BY)
    return rounded(out, "brand_rate", "baseline_rate", "ratio", "suppression")


@query(_TOKENS + f""", vocab AS (
  SELECT corpus_id, token FROM counts WHERE brand_count >= 3 AND NOT (contains(token, '''') OR token IN ({_quoted(L.URL_NOISE)}) OR length(token) < 4)
), tf AS (
  SELECT corpus_id, doc_seq, token, count(*) AS tf FROM content SEMI JOIN vocab USING (corpus_id, token) GROUP BY ALL
), n AS (SELECT corpus_id, count(*) AS n FROM docs GROUP BY corpus_id),
idf AS (
  SELECT corpus_id, token, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
  FROM (SELECT corpus_id, token, count(*) AS df FROM tf GROUP BY ALL) JOIN n USING (corpus_id)
), w AS (SELECT corpus_id, doc_seq, token, tf * idf AS w FROM tf JOIN idf USING (corpus_id, token)),
norm AS (SELECT corpus_id, doc_seq, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL)
SELECT corpus_id, token, round(sum(w / norm), 6) AS weight FROM w JOIN norm USING (corpus_id, doc_seq) GROUP BY ALL""")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    return rounded(W.tfidf(docs, BY, W.in_cluster_vocabulary()), "weight")


@query(_TOKENS + f" SELECT corpus_id, token, brand_count FROM counts WHERE brand_count >= 3 AND NOT (contains(token, '''') OR token IN ({_quoted(L.URL_NOISE)}) OR length(token) < 4)")
def cluster_vocab_filter(spark: SparkSession, d: str) -> DataFrame:
    return W.cluster_vocabulary(W.token_counts(corpus(spark, d), BY))


@query(f"SELECT DISTINCT token, contains(token, '''') OR token IN ({_quoted(L.URL_NOISE)}) OR length(token) < 4 AS noise FROM signature_words WHERE token IS NOT NULL")
def display_noise(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "signature_words").where(F.col("token").isNotNull())
    return rows.select("token", T.is_display_noise(F.col("token")).alias("noise")).distinct()


# Sentences


@query(f"""WITH {_DOCS}, pieces AS (
  SELECT corpus_id, doc_seq, list_filter(list_transform(string_split(regexp_replace(text, '([.!?][.!?"”’'')\\]]*)\\s+', '\\1' || chr(30), 'g'), chr(30)),
         lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS p FROM docs
) SELECT corpus_id, doc_seq, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS sent_seq, unnest(p) AS sentence FROM pieces""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return C.split_sentences(corpus(spark, d), BY)


@query(f"""WITH {_DOCS}, {_sentences()} SELECT corpus_id, doc_seq, count(*) AS usable FROM sentences
WHERE len(regexp_extract_all(sentence, '[^\\s\\x0b\\x{{85}}\\p{{Z}}]+')) BETWEEN 3 AND 60 AND length(sentence) <= 500
  AND NOT contains(sentence, chr(10) || chr(10)) GROUP BY ALL""")
def usable_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = C.split_sentences(corpus(spark, d), BY).where(T.is_usable_sentence(F.col("sentence")))
    return rows.groupBy(*BY, "doc_seq").agg(F.count(F.lit(1)).alias("usable"))


@query(f"{_CADENCE_OF} SELECT corpus_id, sentence_count, word_count, {_ROUNDED} FROM cadence")
def cadence_by_corpus(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.cadence(corpus(spark, d), BY), *C.MEASURES)


@query(f"{_EXACT_OF} SELECT corpus_id, sentence_count, word_count, {_ROUNDED} FROM cadence")
def cadence_exact(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.cadence(corpus(spark, d), BY, exact=True), *C.MEASURES)


@query(f"{_CADENCE_OF} SELECT corpus_id, p25_length, p50_length, p75_length FROM cadence")
def cadence_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return C.cadence(corpus(spark, d), BY).select(*BY, "p25_length", "p50_length", "p75_length")


@query(f"{_CADENCE_OF} SELECT corpus_id, round(pronoun_ratio_first, 6) AS pronoun_ratio_first, round(pronoun_ratio_second, 6) AS pronoun_ratio_second FROM cadence")
def pronoun_ratios(spark: SparkSession, d: str) -> DataFrame:
    names = ["pronoun_ratio_first", "pronoun_ratio_second"]
    return rounded(C.cadence(corpus(spark, d), BY).select(*BY, *names), *names)


@query(f"{_CADENCE_OF} SELECT corpus_id, round(punct_density, 6) AS punct_density FROM cadence")
def punct_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.cadence(corpus(spark, d), BY).select(*BY, "punct_density"), "punct_density")


@query(f"{_CADENCE_OF} SELECT corpus_id, round(question_rate, 6) AS question_rate, round(exclamation_rate, 6) AS exclamation_rate FROM cadence")
def question_exclaim_rates(spark: SparkSession, d: str) -> DataFrame:
    names = ["question_rate", "exclamation_rate"]
    return rounded(C.cadence(corpus(spark, d), BY).select(*BY, *names), *names)


@query(f"""WITH {_DOCS}, {_sentences()}, {_MEASURED}, edges AS (
  SELECT corpus_id, min(n_words) - CASE WHEN min(n_words) = max(n_words) THEN 0.5 ELSE 0.0 END AS a,
         max(n_words) + CASE WHEN min(n_words) = max(n_words) THEN 0.5 ELSE 0.0 END AS b FROM kept GROUP BY corpus_id
), placed AS (
  SELECT k.corpus_id, least(CAST(floor((n_words - CAST(a AS DOUBLE)) / (CAST(b - a AS DOUBLE) / 10)) AS INTEGER), 9) AS bin FROM kept k JOIN edges e ON k.corpus_id = e.corpus_id
), grid AS (SELECT corpus_id, a, b, unnest(range(0, 10)) AS bin FROM edges), filled AS (
  SELECT g.corpus_id, CAST(g.bin AS INTEGER) AS bin, a, b, count(p.bin) AS n
  FROM grid g LEFT JOIN placed p ON g.corpus_id = p.corpus_id AND g.bin = p.bin GROUP BY ALL
) SELECT corpus_id, bin, round(CAST(a AS DOUBLE) + bin * (CAST(b - a AS DOUBLE) / 10), 6) AS lo, round(CAST(a AS DOUBLE) + (bin + 1) * (CAST(b - a AS DOUBLE) / 10), 6) AS hi, n,
         repeat('█', CAST(floor(n * 40 / CAST(max(n) OVER (PARTITION BY corpus_id) AS DOUBLE)) AS INTEGER)) AS bar FROM filled""")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    measured = C.measure_sentences(C.split_sentences(corpus(spark, d), BY))
    return rounded(C.length_histogram(measured, BY), "lo", "hi")


@query(f"""WITH {_DOCS} SELECT corpus_id, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\\s\\x0b\\x{{85}}\\p{{Z}}]+')), 0)) AS BIGINT) AS total_words FROM docs GROUP BY corpus_id""")
def total_words(spark: SparkSession, d: str) -> DataFrame:
    return C.total_words(corpus(spark, d), BY)


@query(f"{_CADENCE_OF} SELECT corpus_id, word_count, word_count < 3000 AS thin_corpus FROM cadence")
def thin_corpus_flag(spark: SparkSession, d: str) -> DataFrame:
    return C.is_thin(C.cadence(corpus(spark, d), BY)).select(*BY, "word_count", "thin_corpus")


@query(f"""{_CADENCE_OF}, lo AS (SELECT corpus_id, greatest(3, CAST(trunc(mean_length - std_length) AS INTEGER)) AS target_lo, mean_length + std_length AS top FROM cadence)
SELECT corpus_id, target_lo, greatest(target_lo + 2, CAST(trunc(top) AS INTEGER)) AS target_hi FROM lo""")
def target_range(spark: SparkSession, d: str) -> DataFrame:
    return C.target_range(C.cadence(corpus(spark, d), BY)).select(*BY, "target_lo", "target_hi")


# Text and files

_SQUEEZE = "array_to_string(list_filter(list_transform(regexp_split_to_array({0}, '\\n[\\s\\x0b\\x{{85}}\\p{{Z}}]*\\n'), lambda p: regexp_replace(regexp_replace(p, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')), lambda p: p <> ''), chr(10) || chr(10))"


@query(f"WITH {_DOCS} SELECT corpus_id, doc_seq, {_SQUEEZE.format('text')} AS text FROM docs WHERE text IS NOT NULL")
def normalize_whitespace(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).where(F.col("text").isNotNull())
    return docs.select(*BY, "doc_seq", T.normalize_whitespace(F.col("text")).alias("text"))


_STRIPPED = "replace(regexp_replace(regexp_replace(text, '(?m)^\\s{0,3}#{1,6}\\s+', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '`', '')"
_TEXTS = f"WITH {_DOCS}, texts AS (SELECT * FROM docs WHERE text IS NOT NULL)"


@query(f"{_TEXTS} SELECT corpus_id, doc_seq, coalesce(regexp_extract(text, '(?m)^\\s*#\\s+(.+?)\\s*$', 1), '') AS heading, {_STRIPPED} AS text FROM texts")
def markdown_strip(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).where(F.col("text").isNotNull())
    return docs.select(*BY, "doc_seq", T.markdown_heading(F.col("text")).alias("heading"), T.strip_markdown(F.col("text")).alias("text"))


@query(f"""{_TEXTS}, parts AS (
  SELECT corpus_id, doc_seq, path, trim(regexp_extract(text, '(?m)^\\s*#\\s+(.+?)\\s*$', 1)) AS heading, {_SQUEEZE.format('text')} AS squeezed FROM texts
), lines AS (
  SELECT *, trim(list_filter(string_split(squeezed, chr(10)), lambda x: trim(x) <> '')[1]) AS first,
         regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM parts
) SELECT corpus_id, doc_seq, CASE WHEN heading <> '' THEN heading[1:120] WHEN length(first) <= 120 THEN first ELSE stem END AS title FROM lines""")
def title_pick(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).where(F.col("text").isNotNull())
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    title = T.pick_title(T.markdown_heading(F.col("text")), T.normalize_whitespace(F.col("text")), stem)
    return docs.select(*BY, "doc_seq", title.alias("title"))


@query()
def file_documents(spark: SparkSession, d: str) -> DataFrame:
    """The folder source over all documents as if they were files."""
    return documents_of_files(corpus(spark, d), F.concat_ws("/", "corpus_id", "path"), F.col("text"))


_SEPARATED = " OR ".join(
    f"(len(string_split(line, '{s}')) > 2 AND len(list_filter(string_split(line, '{s}'), lambda p: trim(p) <> '')) > 0 AND len(list_filter(string_split(line, '{s}'), lambda p: length(trim(p)) >= 60)) = 0)"
    for s in L.TRAIL_SEPARATORS
)


@query(f"""WITH {_DOCS}, lines AS (
  SELECT corpus_id, doc_seq, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line
  FROM docs
) SELECT corpus_id, doc_seq, line_no FROM lines WHERE {_SEPARATED}""")
def breadcrumb_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus(spark, d).select(*BY, "doc_seq", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(T.is_trail(F.col("line"))).select(*BY, "doc_seq", (F.col("pos") + 1).alias("line_no"))


# Pages and addresses

_PARTS = "'^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#]+)([^?#;]*)'"


def _sql_path(u: str) -> str:
    return f"(CASE WHEN regexp_extract({u}, {_PARTS}, 3) = '' THEN '/' ELSE regexp_extract({u}, {_PARTS}, 3) END)"


def _sql_host(u: str) -> str:
    return f"lower(regexp_extract({u}, {_PARTS}, 2))"


def _sql_normal(u: str) -> str:
    return f"(CASE WHEN regexp_extract({u}, {_PARTS}, 1) = '' THEN '' ELSE lower(regexp_extract({u}, {_PARTS}, 1)) || '://' || {_sql_host(u)} || {_sql_path(u)} END)"


def _sql_skip(p: str) -> str:
    import re

    prefixes, suffixes = "|".join(map(re.escape, L.SKIP_PREFIXES)), "|".join(map(re.escape, L.SKIP_EXTENSIONS))
    return f"regexp_matches(lower({p}), '^(?:{prefixes})|(?:{suffixes})$')"


def _sql_priority(p: str) -> str:
    q = f"regexp_replace(lower({p}), '/+$', '')"
    return f"""(CASE WHEN {q} = '' THEN 10 WHEN regexp_matches({q}, '^/about(?:/|$)') THEN 8 WHEN {q} IN ('/blog', '/posts') THEN 6
  WHEN regexp_matches({q}, '^/(?:blog|posts)/') THEN 5 WHEN regexp_matches({q}, '^/(?:services|pricing|work|portfolio|case-studies)(?:/|$)') THEN 4 ELSE 2 END)"""


@query(f"SELECT page_id, {_sql_normal('url')} AS link FROM pages WHERE url IS NOT NULL")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where("url IS NOT NULL").select("page_id", U.normalize(F.col("url")).alias("link"))


@query(f"SELECT page_id, {_sql_skip(_sql_path('url'))} AS skip FROM pages WHERE url IS NOT NULL")
def url_skip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where("url IS NOT NULL").select("page_id", U.should_skip(U.path(F.col("url"))).alias("skip"))


@query(f"SELECT page_id, {_sql_priority(_sql_path('url'))} AS priority FROM pages WHERE url IS NOT NULL")
def url_priority(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where("url IS NOT NULL").select("page_id", U.priority(U.path(F.col("url"))).alias("priority"))


_SCHEME = f"regexp_extract(url, {_PARTS}, 1)"


@query(f"""WITH hrefs AS (
  SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS hs FROM pages WHERE html IS NOT NULL
), found AS (
  SELECT page_id, url, CAST(generate_subscripts(hs, 1) - 1 AS INTEGER) AS position, trim(unnest(hs)) AS href FROM hrefs
), parted AS (
  SELECT *, regexp_extract(href, '^[^?#;]*') AS bare FROM found
), joined AS (
  SELECT *, CASE WHEN starts_with(bare, '/') THEN bare ELSE regexp_replace({_sql_path('url')}, '[^/]*$', '') || bare END AS whole FROM parted
), undotted AS (
  SELECT *, string_split(whole, '/') AS segments FROM joined
), resolved AS (
  SELECT *, list_reduce(list_filter(segments[2:], lambda s, i: s <> '.' AND (s <> '' OR starts_with(bare, '/') OR i = len(segments) - 1)),
      lambda done, s: CASE WHEN s = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || s END, '')
    || CASE WHEN segments[-1] IN ('.', '..') THEN '/' ELSE '' END AS undot FROM undotted
), full_links AS (
  SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href
    WHEN starts_with(href, '//') THEN {_SCHEME} || ':' || href
    WHEN bare = '' THEN url
    ELSE {_SCHEME} || '://' || {_sql_host('url')} || CASE WHEN undot = '' THEN '/' ELSE undot END END AS full_link FROM resolved
), links AS (SELECT page_id, position, {_sql_host('url')} AS host, {_sql_normal('full_link')} AS link FROM full_links)
SELECT page_id, min(position) AS position, link FROM links
WHERE link <> '' AND {_sql_host('link')} = host AND NOT {_sql_skip(_sql_path('link'))} GROUP BY page_id, link""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return P.page_links(table(spark, d, "pages"))


@query(f"""WITH rows AS (SELECT {_sql_host('url')} AS host, page_id, {_sql_normal('url')} AS link, {_sql_priority(_sql_path('url'))} AS priority FROM pages WHERE url IS NOT NULL),
once AS (SELECT host, link, min(page_id) AS page_id, max(priority) AS priority FROM rows WHERE link <> '' AND NOT {_sql_skip(_sql_path('link'))} GROUP BY host, link)
SELECT host, page_id, link, priority, row_number() OVER (PARTITION BY host ORDER BY priority DESC, page_id) AS place FROM once""")
def crawl_order(spark: SparkSession, d: str) -> DataFrame:
    return P.crawl_order(table(spark, d, "pages"))


@query()
def page_extract(spark: SparkSession, d: str) -> DataFrame:
    return P.page_documents(table(spark, d, "pages"))


# Tone

_RUNS = """runs AS (
  SELECT corpus_id, run_no, arg_min(c, run_at) AS r FROM (SELECT corpus_id, run_no, run_at, cadence_in AS c FROM cadence_in) GROUP BY corpus_id, run_no
), flat AS (SELECT corpus_id, run_no, r.sentence_count AS sentence_count, r.word_count AS word_count, """ + ", ".join(
    f"coalesce(r.{s}, 0.0) AS {s}" for s in N.SIGNALS
) + ", CASE WHEN len(list_filter(coalesce(r.sig_tokens, []), lambda t: contains(t, ''''))) > 0 THEN 1.0 ELSE 0.0 END AS has_contractions FROM runs)"


def _sql_fires(signal: str, least: float | None, most: float | None, closed: bool) -> str:
    parts = [] if least is None else [f"{signal} {'>=' if closed else '>'} {least}"]
    parts += [] if most is None else [f"{signal} {'<=' if closed else '<'} {most}"]
    return f"CAST({' AND '.join(parts)} AS INTEGER)"


_SCORES = "scored AS (SELECT *, " + ", ".join(
    "(" + " + ".join(_sql_fires(*t) for t in triggers) + f") / {len(triggers)}.0 AS score_{label}" for label, triggers in L.TONE_RULES
) + " FROM flat)"
_SCORE_NAMES = [f"score_{x}" for x in N.LABELS]


@query(f"WITH {_RUNS}, {_SCORES} SELECT corpus_id, run_no, {', '.join(f'round(CAST({s} AS DOUBLE), 6) AS {s}' for s in _SCORE_NAMES)} FROM scored")
def tone_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.scores(cadence_runs(spark, d)).select("corpus_id", "run_no", *_SCORE_NAMES), *_SCORE_NAMES)


_LONG = " UNION ALL ".join(
    f"SELECT corpus_id, run_no, sentence_count, word_count, {i} AS i, '{x}' AS label, CAST(score_{x} AS DOUBLE) AS s FROM scored" for i, x in enumerate(N.LABELS)
)


@query(f"""WITH {_RUNS}, {_SCORES}, long AS ({_LONG}),
placed AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, run_no ORDER BY s DESC, i) AS place FROM long),
pairs AS (SELECT a.corpus_id, a.run_no, a.label, a.s, b.label AS label2, b.s AS s2, coalesce(a.sentence_count, 0) = 0 OR coalesce(a.word_count, 0) = 0 AS nothing
  FROM placed a JOIN placed b ON a.corpus_id = b.corpus_id AND a.run_no = b.run_no AND a.place = 1 AND b.place = 2)
SELECT corpus_id, run_no, CASE WHEN nothing THEN 'unknown' WHEN s = 0 THEN 'mixed' ELSE label END AS primary_tone,
       CASE WHEN NOT nothing AND s > 0 AND s2 >= 0.5 AND s2 >= s - 0.25 THEN label2 END AS secondary_tone,
       round(CASE WHEN nothing THEN 0.0 ELSE s END, 6) AS confidence, CASE WHEN nothing THEN 0.0 ELSE s END < 0.6 AS uncertain FROM pairs""")
def tone_label(spark: SparkSession, d: str) -> DataFrame:
    out = N.classify(cadence_runs(spark, d))
    return rounded(out.select("corpus_id", "run_no", "primary_tone", "secondary_tone", "confidence", "uncertain"), "confidence")


# Vectors and clusters

_UNIT = """norms AS (SELECT vec_id, label, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings WHERE embedding IS NOT NULL),
units AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) / CASE WHEN norm > 0 THEN norm ELSE 1 END AS x FROM norms)"""


def _sql_middle(by: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""means AS (SELECT {keys}pos, avg(x) AS m FROM units GROUP BY {keys}pos),
middle AS (SELECT {keys}pos, m / (sqrt(sum(m * m) OVER ({part})) + 1e-12) AS c FROM means)"""


def _sql_distance(by: str) -> str:
    return f"distances AS (SELECT vec_id, label, 1.0 - sum(x * c) AS distance FROM units u JOIN middle m USING (pos{', ' + by if by else ''}) GROUP BY vec_id, label)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("embedding").isNotNull())


@query(f"WITH {_UNIT}, {_sql_middle('')} SELECT pos, round(c, 6) AS x FROM middle")
def corpus_centroid(spark: SparkSession, d: str) -> DataFrame:
    middle = V.centroids(_vectors(spark, d), [])
    return rounded(middle.select(F.posexplode("centroid").alias("pos", "x")), "x")


def _extremes_sql(order: str) -> str:
    return f"""WITH {_UNIT}, {_sql_middle('')}, {_sql_distance('')}, placed AS (
  SELECT vec_id, distance, row_number() OVER (ORDER BY round(distance, 9) {order}, vec_id) AS rank FROM distances
) SELECT vec_id, round(distance, 6) AS distance, rank FROM placed WHERE rank <= 8"""


def _extremes(spark: SparkSession, d: str, nearest: bool) -> DataFrame:
    rows = _vectors(spark, d)
    measured = V.distances(rows, V.centroids(rows, []), [])
    return rounded(V.extremes(measured, [], ["vec_id"], nearest=nearest).select("vec_id", "distance", "rank"), "distance")


@query(_extremes_sql("ASC"))
def closest_exemplars(spark: SparkSession, d: str) -> DataFrame:
    return _extremes(spark, d, True)


@query(_extremes_sql("DESC"))
def farthest_exemplars(spark: SparkSession, d: str) -> DataFrame:
    return _extremes(spark, d, False)


@query(f"WITH {_UNIT}, {_sql_middle('label')} SELECT label, pos, round(c, 6) AS x FROM middle")
def cluster_centroids_by_label(spark: SparkSession, d: str) -> DataFrame:
    middle = V.centroids(_vectors(spark, d), ["label"])
    return rounded(middle.select("label", F.posexplode("centroid").alias("pos", "x")), "x")


@query(f"""WITH {_UNIT}, {_sql_middle('label')}, {_sql_distance('label')}, placed AS (
  SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), vec_id) AS rank FROM distances
) SELECT label, vec_id AS exemplar FROM placed WHERE rank = 1""")
def cluster_exemplar(spark: SparkSession, d: str) -> DataFrame:
    return K.exemplars(_vectors(spark, d), ["label"], "vec_id").withColumnRenamed("centroid_token", "exemplar")


@query(f"""WITH {_UNIT}, {_sql_middle('label')},
cosines AS (SELECT vec_id, f.label AS cluster, sum(x * c) AS cosine FROM units u JOIN middle f USING (pos) GROUP BY ALL)
SELECT vec_id, round(1.0 - max(cosine), 6) AS min_cluster_distance, 1.0 - max(cosine) <= 0.55 AS stylistic FROM cosines GROUP BY vec_id""")
def forbidden_semantic_partition(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as candidates, the centroids of the labels as clusters."""
    rows = _vectors(spark, d)
    middles = V.centroids(rows, ["label"])
    return rounded(V.semantic_partition(rows, middles).select("vec_id", "min_cluster_distance", "stylistic"), "min_cluster_distance")


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the baseline with their rates as weights, parted by length: clusters for the ranking operators."""
    rows = baseline(spark, d).where(F.col("token").isNotNull())
    return rows.select("token", F.coalesce("rate", F.lit(0.0)).alias("weight"), (F.length("token") % 6).alias("cluster"))


_MEMBERS = """members AS (SELECT token, coalesce(rate, 0.0) AS weight, length(token) % 6 AS cluster FROM baseline_in WHERE token IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 6) DESC, token) AS rank FROM members)"""


@query(f"""WITH {_MEMBERS}, top AS (SELECT cluster, string_agg(token, ', ' ORDER BY rank) AS label FROM placed WHERE rank <= 3 GROUP BY cluster),
words AS (SELECT cluster, string_agg(token, ' ' ORDER BY rank) AS top_tokens FROM placed WHERE rank <= 12 GROUP BY cluster),
sizes AS (SELECT cluster, count(*) AS size FROM members GROUP BY cluster)
SELECT CAST(cluster AS INTEGER) AS cluster, label, top_tokens, size FROM top JOIN words USING (cluster) JOIN sizes USING (cluster)""")
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    out = K.labels(_weighted(spark, d), ["cluster"])
    return out.withColumn("top_tokens", F.array_join(F.transform("top_tokens", lambda t: t["token"]), " "))


@query(f"""WITH {_MEMBERS}, shares AS (
  SELECT cluster, avg(CASE WHEN token IN ({_quoted(L.STOPWORDS)}) THEN 1.0 ELSE 0.0 END) AS stop_share FROM placed WHERE rank <= 8 GROUP BY cluster
), sizes AS (SELECT cluster, count(*) AS size FROM members GROUP BY cluster)
SELECT CAST(cluster AS INTEGER) AS cluster, size, round(stop_share, 6) AS stop_share FROM sizes JOIN shares USING (cluster) WHERE size >= 4 AND stop_share <= 0.6""")
def stopword_cluster_drop(spark: SparkSession, d: str) -> DataFrame:
    out = K.surviving(_weighted(spark, d), ["cluster"], list(L.STOPWORDS))
    return rounded(out.select("cluster", "size", "stop_share"), "stop_share")


@query()
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return K.kmeans(_vectors(spark, d)).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


@query()
def fingerprint_sketch(spark: SparkSession, d: str) -> DataFrame:
    out = sketch(corpus(spark, d), baseline(spark, d))
    lists = ("signature_words", "forbidden_words", "top_vocab")
    return out.withColumns({c: F.to_json(c) for c in lists}).drop("sig_tokens")

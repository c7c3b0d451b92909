"""Vocabulary of corpora against a baseline.

Tokens are counted in each document before anything is shuffled, so a corpus that holds a
third of all documents still spreads over all tasks: partial counts are merged by (corpus,
token), never by corpus alone. Ranks within a corpus come after filters and use a window
over counts, not over tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcorpus.functions import lists as L
from voxcorpus.functions import text as T
from voxcorpus.functions.rows import beside, join_on


#: Tokens that are sent to all tasks with their weights (some 75 MB in each); of more, the frequencies are exchanged.
MOST_KNOWN = 500_000
#: Tokens that a task counts before it hands their counts on.
HELD = 200_000


def tokens(docs: DataFrame, by: list[str], content: bool = True) -> DataFrame:
    """``*by, doc_seq, token``, one row for each occurrence; content: without stopwords and short ones."""
    rows = docs.select(*by, "doc_seq", F.explode(T.words(F.col("text"))).alias("token"))
    return rows.where(T.is_content(F.col("token"))) if content else rows


def token_counts(docs: DataFrame, by: list[str], content: bool = True) -> DataFrame:
    """``*by, token, brand_count``."""
    return tokens(docs, by, content).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("brand_count"))


def token_spread(docs: DataFrame) -> DataFrame:
    """``token, brand_count, df`` of one corpus: occurrences, and documents (rows) that hold the token. One pass over
    the texts; a task hands on a row for each of its tokens, not for each occurrence."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(L.WORD).findall
        every, once = Counter(), Counter()
        rows = lambda: pa.RecordBatch.from_pydict({"token": list(every), "n": [*every.values()], "d": [once[t] for t in every]})
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = find(text)
                every.update(found)
                once.update(set(found))
                if len(every) > HELD:
                    yield rows()
                    every, once = Counter(), Counter()
        if every:
            yield rows()

    parts = docs.where(F.col("text").isNotNull()).select(F.lower("text")).mapInArrow(count, "token string, n bigint, d bigint")
    sums = parts.groupBy("token").agg(F.sum("n").alias("brand_count"), F.sum("d").alias("df"))
    return sums.where(T.is_content(F.col("token")))


def document_counts(docs: DataFrame, by: list[str]) -> DataFrame:
    """``*by, doc_seq, token, tf``."""
    return tokens(docs, by).groupBy(*by, "doc_seq", "token").agg(F.count(F.lit(1)).alias("tf"))


def top_vocabulary(counts: DataFrame, by: list[str], n: int = L.TOP_VOCABULARY) -> DataFrame:
    """The n most frequent tokens of each group, ties by token; ``rank`` from 1."""
    w = Window.partitionBy(*by).orderBy(F.desc("brand_count"), "token")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def brand_rates(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``brand_rate``, occurrences in a million of the group's tokens."""
    totals = counts.groupBy(*by).agg(F.sum("brand_count").alias("total"))
    joined = join_on(counts, totals, by) if by else beside(counts, totals)
    return joined.select(*by, "token", "brand_count", (F.col("brand_count") * 1e6 / F.col("total")).alias("brand_rate"))


def baseline_from(docs: DataFrame, top: int = L.BASELINE_TOP) -> DataFrame:
    """``token, cnt, rate, rnk`` of the most frequent tokens of any documents; rates are of all tokens,
    those beyond the top included."""
    counts = token_counts(docs, []).withColumnRenamed("brand_count", "cnt")
    total = counts.agg(F.sum("cnt")).first()[0] or 1
    ranked = counts.orderBy(F.desc("cnt"), "token").limit(top)
    w = Window.orderBy(F.desc("cnt"), "token")  # at most ``top`` rows
    return ranked.select("token", "cnt", (F.col("cnt") * 1e6 / F.lit(total)).alias("rate"), F.row_number().over(w).alias("rnk"))


def _baseline(baseline: DataFrame, top: int = L.BASELINE_TOP) -> DataFrame:
    """A baseline is at most ``top`` tokens, whatever table it comes from; null rates count as 0."""
    return baseline.where((F.col("rnk") <= top) & F.col("token").isNotNull()).select(
        "token", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("rate", F.lit(0.0)).alias("rate"), "rnk"
    )


def signature_words(
    rates: DataFrame, baseline: DataFrame, by: list[str], min_count: int = L.MIN_BRAND_COUNT, top: int = L.TOP_SIGNATURE
) -> DataFrame:
    """The tokens a group uses most beyond the baseline: ``*by, token, brand_rate, baseline_rate, ratio,
    brand_count, rank``; ties by token."""
    base = F.broadcast(_baseline(baseline).select("token", "cnt", F.col("rate").alias("baseline_rate")))
    joined = rates.where(F.col("brand_count") >= min_count).join(base, "token", "left").fillna(0.0, ["baseline_rate"])
    kept = joined.where((F.coalesce("cnt", F.lit(0)) >= L.NOISE_FLOOR) | (F.col("brand_count") >= L.NOISE_FLOOR))
    scored = kept.withColumn("ratio", F.col("brand_rate") / (F.col("baseline_rate") + 1.0))
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("ratio", 6)), "token")
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= top)
        .select(*by, "token", "brand_rate", "baseline_rate", "ratio", "brand_count", "rank")
    )


def forbidden_candidates(
    rates: DataFrame,
    baseline: DataFrame,
    groups: DataFrame,
    by: list[str],
    min_count: int = L.MIN_BRAND_COUNT,
    top: int = L.TOP_FORBIDDEN,
) -> DataFrame:
    """Common tokens of the baseline that a group avoids, most suppressed first.

    The pool is ``GENERIC_POOL`` tokens for each group (so its size is known), less generic noise:
    ``*by, token, brand_rate, baseline_rate, ratio, suppression, brand_count, rank``.
    """
    w0 = Window.orderBy(F.desc("rate"), "rnk", "token")  # at most BASELINE_TOP rows
    pool = (
        _baseline(baseline)
        .withColumn("place", F.row_number().over(w0))
        .where((F.col("place") <= L.GENERIC_POOL) & ~F.col("token").isin(*L.GENERIC_NOISE))
        .agg(F.collect_list(F.struct("token", F.col("rate").alias("baseline_rate"), "place")).alias("pool"))
    )
    # every group beside the one pool row, then one row for each of its tokens
    wide = beside(groups.select(*by).distinct(), pool) if by else pool
    wide = wide.select(*by, F.explode("pool").alias("p")).select(*by, "p.*")
    scored = (
        join_on(wide, rates, [*by, "token"], "left")
        .fillna(0, ["brand_rate", "brand_count"])
        .where(F.col("brand_count") < min_count)
        .withColumn("ratio", F.col("brand_rate") / (F.col("baseline_rate") + 1e-6))
        .withColumn("suppression", F.col("baseline_rate") / (F.col("brand_rate") + 1.0))
    )
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("suppression", 6)), "token")
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= top)
        .select(*by, "token", "brand_rate", "baseline_rate", "ratio", "suppression", "brand_count", "rank")
    )


def shown_signature(signature: DataFrame, by: list[str], n: int = L.SHOWN_SIGNATURE) -> DataFrame:
    """The first n signature words of each group that are worth showing, with their ``place`` among these."""
    w = Window.partitionBy(*by).orderBy("rank")  # TOP_SIGNATURE rows a group
    kept = signature.where(~T.is_display_noise(F.col("token")))
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(*by, "token", "place")


def vocabulary_stats(counts: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """``*by, brand_unique_tokens, brand_total_tokens, baseline_unique_tokens, baseline_total_tokens``; a group
    without tokens has no row."""
    brand = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("brand_unique_tokens"), F.sum("brand_count").alias("brand_total_tokens"))
    base = _baseline(baseline).agg(
        F.count(F.lit(1)).alias("baseline_unique_tokens"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("baseline_total_tokens")
    )
    return beside(brand, base)


def in_cluster_vocabulary(min_count: int = L.CLUSTER_MIN_COUNT) -> Column:
    """Whether a token is frequent enough and worth showing."""
    return (F.col("brand_count") >= min_count) & ~T.is_display_noise(F.col("token"))


def cluster_vocabulary(counts: DataFrame, min_count: int = L.CLUSTER_MIN_COUNT) -> DataFrame:
    """Tokens frequent enough and worth showing."""
    return counts.where(in_cluster_vocabulary(min_count))


def tfidf(docs: DataFrame, by: list[str], keep: Column | None = None) -> DataFrame:
    """``*by, token, weight``: summed weights of the tokens over the documents of a group.

    Smoothed inverse frequencies, ln((1 + n) / (1 + df)) + 1; a document's weights have length one
    within the vocabulary: the tokens that ``keep`` is true of, a condition over ``token`` and ``brand_count``.

    Frequencies are exchanged once, by document and token. Counts and document frequencies are one aggregation
    of them; both readers share the exchange. A document's weights then meet once, as an array no longer
    than its vocabulary, for their norm and their sums alike.
    """
    tf = document_counts(docs, by)
    n = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else docs.agg(F.count(F.lit(1)).alias("n"))
    stats = tf.groupBy(*by, "token").agg(F.sum("tf").alias("brand_count"), F.count(F.lit(1)).alias("df"))
    if keep is not None:
        stats = stats.where(keep)
    idf = join_on(stats, n, by) if by else beside(stats, n)
    idf = idf.select(*by, "token", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    weighted = join_on(tf, idf, [*by, "token"]).select(*by, "doc_seq", "token", (F.col("tf") * F.col("idf")).alias("w"))
    document = weighted.groupBy(*by, "doc_seq").agg(
        F.collect_list(F.struct("token", "w")).alias("ws"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )
    parts = document.select(*by, "norm", F.explode("ws").alias("x"))
    return parts.groupBy(*by, F.col("x.token").alias("token")).agg(F.sum(F.col("x.w") / F.col("norm")).alias("weight"))


def tfidf_known(docs: DataFrame, stats: DataFrame, n: int, keep: Column) -> DataFrame:
    """``token, weight``: as ``tfidf`` of one corpus of ``n`` documents (rows), where ``stats``, ``token_spread`` of
    them, is known already.

    Up to ``MOST_KNOWN`` tokens that ``keep`` is true of go to all tasks, each document is weighed where it is
    read, and tasks hand on their sums by token. Of more tokens none are sent: frequencies are exchanged.
    """
    spark = docs.sparkSession
    idf = F.log((1.0 + F.lit(n)) / (1.0 + F.col("df"))) + 1.0
    known = stats.where(keep).select("token", idf.alias("idf")).limit(MOST_KNOWN + 1).toArrow()
    if known.num_rows > MOST_KNOWN:
        return tfidf(docs.withColumn("_all", F.lit(0)), ["_all"], keep).select("token", "weight")
    names = known["token"].to_pylist()
    sent = spark.sparkContext.broadcast(({t: i for i, t in enumerate(names)}, known["idf"].to_numpy()))
    del names, known

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(L.WORD).findall
        places, idf = sent.value
        sums = np.zeros(len(places))
        for batch in batches:
            ids, sizes = [], []
            for text in batch.column(0).to_pylist():
                found = [i for i in map(places.get, find(text)) if i is not None]
                ids += found
                sizes.append(len(found))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pairs, tf = np.unique(owner * len(places) + np.array(ids, "int64"), return_counts=True)
            owner, token = np.divmod(pairs, max(1, len(places)))
            w = tf * idf[token]
            norm = np.sqrt(np.bincount(owner, w * w, len(sizes)))
            sums += np.bincount(token, w / norm[owner], len(places))
        names = list(places)
        some = np.nonzero(sums)[0]
        for i in range(0, len(some), 10_000):
            part = some[i : i + 10_000]
            yield pa.RecordBatch.from_pydict({"token": [names[j] for j in part], "w": sums[part]})

    parts = docs.where(F.col("text").isNotNull()).select(F.lower("text")).mapInArrow(weigh, "token string, w double")
    return parts.groupBy("token").agg(F.sum("w").alias("weight"))

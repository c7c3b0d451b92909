"""Sentence rhythm of corpora.

Every measure of a sentence is a built-in expression; a corpus needs one aggregation with
partial sums. Sentences are cut document by document. ``exact=True`` cuts a corpus as if its documents
were one text, in document order and with blank lines between: the documents are cut as before, and only
their first and last pieces are mended where a sentence runs on into the next document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcorpus.functions import lists as L
from voxcorpus.functions import text as T
from voxcorpus.functions.rows import join_on, running
from voxcorpus.operators import vectors as V

MEASURES = [
    "mean_length", "std_length", "p25_length", "p50_length", "p75_length", "pronoun_ratio_first", "pronoun_ratio_second",
    "punct_density", "question_rate", "exclamation_rate", "fragment_rate",
]


def split_sentences(docs: DataFrame, by: list[str], exact: bool = False) -> DataFrame:
    """``*by, doc_seq, sent_seq, sentence``; null and blank texts have no sentences.

    exact: a sentence may run on over documents; it is named after the document it begins in.
    """
    if not exact:
        return docs.select(*by, "doc_seq", F.posexplode(T.sentences(F.col("text"))).alias("sent_seq", "sentence"))
    pieces = docs.select(*by, "doc_seq", T.open_pieces(F.col("text")).alias("p")).withColumn("breaks", F.size("p") - 1)
    whole = pieces.where("breaks > 1").select(*by, "doc_seq", F.posexplode("p").alias("sent_seq", "sentence"), "breaks")
    whole = whole.where("sent_seq > 0 AND sent_seq < breaks").drop("breaks")
    # A document's first piece goes on with what is open; its last one stays open. Pieces with as many ends
    # before them are one sentence, whatever documents they lie in.
    ends = pieces.select(*by, "doc_seq", "breaks", F.element_at("p", 1).alias("first"), F.element_at("p", -1).alias("last"))
    ends = running(ends, by, [], "doc_seq", F.col("breaks"), "ends_before")
    part = lambda n, seq, text: F.struct(n.alias("n"), F.col("doc_seq"), seq.alias("sent_seq"), text.alias("t"))
    both = F.array(
        part(F.col("ends_before"), F.lit(0), F.col("first")), part(F.col("ends_before") + F.col("breaks"), F.col("breaks"), F.col("last"))
    )
    parts = ends.select(*by, F.explode(F.when(F.col("breaks") > 0, both).otherwise(F.slice(both, 1, 1))).alias("x")).select(*by, "x.*")
    ordered = F.array_sort(F.collect_list(F.struct("doc_seq", "sent_seq", "t")))
    mended = parts.groupBy(*by, "n").agg(ordered.alias("o")).select(
        *by, F.col("o")[0]["doc_seq"].alias("doc_seq"), F.col("o")[0]["sent_seq"].alias("sent_seq"),
        F.array_join(F.transform("o", lambda x: x["t"]), "").alias("sentence"),
    )
    out = whole.unionByName(mended).withColumn("sentence", T.stripped(F.col("sentence")))
    return out.where(F.col("sentence") != "")


def measure_sentences(sentences: DataFrame) -> DataFrame:
    """Adds counts of words, marks and pronouns; clitics count as words. Sentences without a word go."""
    parted = T.part_clitics(F.col("sentence"))
    return sentences.withColumn("n_words", T.count_words(parted)).where(F.col("n_words") > 0).withColumns(_counts(parted))


def _counts(parted: Column) -> dict[str, Column]:
    return {
        "n_marks": T.count_marks(parted), "n_first": T.count_of(parted, L.FIRST_PERSON), "n_second": T.count_of(parted, L.SECOND_PERSON),
    }


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def aggregate_cadence(measured: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group that has a sentence: counts and the eleven measures."""
    n = F.col("n_words").cast("double")
    words = F.sum("n_words").cast("double")
    quartiles = F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    last = F.rtrim("sentence")
    return (
        measured.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("sentence_count"),
            F.sum("n_words").cast("bigint").alias("word_count"),
            F.avg(n).alias("mean_length"),
            F.stddev_pop(n).alias("std_length"),
            quartiles.alias("q"),
            (F.sum("n_first") / words).alias("pronoun_ratio_first"),
            (F.sum("n_second") / words).alias("pronoun_ratio_second"),
            (F.sum("n_marks") * 100.0 / words).alias("punct_density"),
            _share(last.endswith("?")).alias("question_rate"),
            _share(last.endswith("!")).alias("exclamation_rate"),
            _share(n < 5).alias("fragment_rate"),
        )
        .select(
            *by, "sentence_count", "word_count", "mean_length", "std_length", F.col("q")[0].alias("p25_length"),
            F.col("q")[1].alias("p50_length"), F.col("q")[2].alias("p75_length"), "pronoun_ratio_first",
            "pronoun_ratio_second", "punct_density", "question_rate", "exclamation_rate", "fragment_rate",
        )
    )


SUMS = ["n", "first", "second", "marks", "questions", "exclamations"]


def lengths_and_mean(sentences: DataFrame, usable: Column, embedder: V.Embedder) -> tuple[list[tuple], np.ndarray | None]:
    """Of one corpus, in one pass over its sentences: the rows of ``n_words`` and ``SUMS``, one for each length, and
    the mean of the vectors of the ``usable`` ones (of length one; None without any). Tasks hand on their sums."""
    parted, last = T.part_clitics(F.col("sentence")), F.rtrim("sentence")
    n_marks = F.size(F.array_remove(F.col("_m"), ""))
    measured = sentences.withColumn("_m", T.marks_in_order(parted)).withColumns(
        _counts(parted) | {"n_marks": n_marks, "n_words": F.size("_m") - n_marks}
    ).select(
        F.when(usable, F.col("sentence")).alias("sentence"), "n_words", "n_first", "n_second", "n_marks",
        last.endswith("?").cast("int").alias("asks"), last.endswith("!").cast("int").alias("calls"),
    )
    schema = ", ".join(["n_words int", *(f"{c} bigint" for c in SUMS), "v array<double>"])
    fields = pa.schema([("n_words", pa.int32()), *((c, pa.int64()) for c in SUMS), ("v", pa.list_(pa.float64()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, np.ndarray] = {}
        n, total = 0, np.zeros(embedder.dim)
        for batch in batches:
            lengths, place = np.unique(batch.column(1).to_numpy(), return_inverse=True)
            columns = [np.bincount(place, minlength=len(lengths))]
            columns += [np.bincount(place, batch.column(i).to_numpy(), len(lengths)) for i in range(2, 7)]
            for x, row in zip(lengths.tolist(), np.column_stack(columns).astype("int64")):
                by_length[x] = by_length[x] + row if x in by_length else row
            texts = batch.column(0).drop_null()
            if len(texts):
                n, total = n + len(texts), total + V.encoded(texts, embedder).sum(0)
        rows = [(x, *map(int, row), None) for x, row in by_length.items() if x > 0] + [(-1, n, *[0] * 5, total.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    got = measured.mapInArrow(sums, schema).groupBy("n_words").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.collect_list(F.struct("n", "v")).alias("vs")
    ).select("n_words", *SUMS, F.when(F.col("n_words") < 0, F.col("vs")).alias("vs")).collect()
    vectors = [(x["n"], x["v"]) for r in got if r["n_words"] < 0 for x in r["vs"]]
    return sorted(tuple(r)[:-1] for r in got if r["n_words"] > 0), V.unit_mean(vectors)


def cadence_of_lengths(lengths: DataFrame, by: list[str]) -> DataFrame:
    """As ``aggregate_cadence``, of sums by length of sentence: ``*by, n_words`` and ``SUMS``."""
    x, n = F.col("n_words").cast("double"), F.col("n")
    count, words = F.sum("n"), F.sum(F.col("n_words") * n)
    quartiles = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n)
    out = lengths.groupBy(*by).agg(
        count.alias("sentence_count"), words.cast("bigint").alias("word_count"), (words / count).alias("mean_length"),
        F.collect_list(F.struct(x.alias("x"), n.alias("n"))).alias("h"), quartiles.alias("q"),
        *[(F.sum(c) * k / total).alias(m) for c, m, k, total in (
            ("first", "pronoun_ratio_first", 1.0, words), ("second", "pronoun_ratio_second", 1.0, words), ("marks", "punct_density", 100.0, words),
            ("questions", "question_rate", 1.0, count), ("exclamations", "exclamation_rate", 1.0, count),
        )],
        (F.sum(F.when(x < 5, n).otherwise(0)) / count).alias("fragment_rate"),
    )
    squares = F.aggregate("h", F.lit(0.0), lambda s, y: s + y["n"] * (y["x"] - F.col("mean_length")) * (y["x"] - F.col("mean_length")))
    out = out.withColumn("std_length", F.sqrt(squares / F.col("sentence_count")))
    out = out.withColumns({m: F.col("q")[i] for i, m in enumerate(("p25_length", "p50_length", "p75_length"))})
    return out.select(*by, "sentence_count", "word_count", *MEASURES)


def cadence(docs: DataFrame, by: list[str], exact: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """Cadence of every group of ``docs``; a group without any sentence has a row of zeros. groups: one row a
    group, where there is such a table already; its columns stay."""
    got = aggregate_cadence(measure_sentences(split_sentences(docs, by, exact)), by)
    if not by:
        return got
    groups = docs.select(*by).distinct() if groups is None else groups
    zeros = {c: 0 for c in ["sentence_count", "word_count"]} | {c: 0.0 for c in MEASURES}
    return join_on(groups, got, by, "left").fillna(zeros)


def sentence_lengths(measured: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``*by, doc_seq, sent_seq, n_words``: words of each sentence, a row each, so that no group is gathered; their
    order is that of doc_seq and sent_seq."""
    return measured.select(*(by or []), "doc_seq", "sent_seq", "n_words")


def length_histogram(measured: DataFrame, by: list[str], bins: int = 10, width: int = 40) -> DataFrame:
    """The histogram of sentences: see ``histogram_of_lengths``."""
    return histogram_of_lengths(measured.groupBy(*by, "n_words").agg(F.count(F.lit(1)).alias("n")), by, bins, width)


def histogram_of_lengths(counted: DataFrame, by: list[str], bins: int = 10, width: int = 40) -> DataFrame:
    """``*by, bin, lo, hi, n, bar``: equal bins between the extremes, the last one closed; a group of one
    length is widened by a half on both sides."""
    # one row for each length of a group, then one for each group: as many entries as there are lengths
    packed = counted.groupBy(*by).agg(
        F.collect_list(F.struct("n_words", "n")).alias("h"), F.min("n_words").cast("double").alias("a"), F.max("n_words").cast("double").alias("b")
    )
    half = F.when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
    wide = packed.select(*by, "h", (F.col("a") - half).alias("lo0"), (F.col("b") + half).alias("hi0"))
    wide = wide.withColumn("step", (F.col("hi0") - F.col("lo0")) / bins)

    def filled(k: Column) -> Column:
        bin_of = lambda x: F.least(F.floor((x["n_words"] - F.col("lo0")) / F.col("step")), F.lit(bins - 1))
        return F.aggregate(F.filter("h", lambda x: bin_of(x) == k), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])

    full = wide.withColumn("ns", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), filled))
    rows = full.select(*by, "lo0", "step", F.array_max("ns").alias("peak"), F.posexplode("ns").alias("bin", "n"))
    return rows.select(
        *by,
        "bin",
        (F.col("lo0") + F.col("bin") * F.col("step")).alias("lo"),
        (F.col("lo0") + (F.col("bin") + 1) * F.col("step")).alias("hi"),
        "n",
        F.repeat(F.lit("█"), F.floor(F.col("n") * width / F.col("peak")).cast("int")).alias("bar"),
    )


def total_words(docs: DataFrame, by: list[str]) -> DataFrame:
    """``*by, total_words``: blank-parted words."""
    n = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    return docs.groupBy(*by).agg(F.sum(F.when(F.col("text").isNull(), 0).otherwise(n)).cast("bigint").alias("total_words"))


def target_range(cadences: DataFrame) -> DataFrame:
    """Adds ``target_lo, target_hi``: sentence lengths within one deviation of the mean."""
    lo = F.greatest(F.lit(3), (F.col("mean_length") - F.col("std_length")).cast("int"))
    return cadences.withColumn("target_lo", lo).withColumn(
        "target_hi", F.greatest(F.col("target_lo") + 2, (F.col("mean_length") + F.col("std_length")).cast("int"))
    )


def is_thin(cadences: DataFrame, words: int = L.THIN_WORDS) -> DataFrame:
    return cadences.withColumn("thin_corpus", F.col("word_count") < words)

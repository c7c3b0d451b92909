"""Cadence of documents as they arrive.

The measures of a sentence are the batch operator's expressions; what a stream keeps are sums
by corpus and window, so state grows with corpora and open windows, not with documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcorpus.operators.cadence import measure_sentences, split_sentences


def windowed_cadence(docs: DataFrame, event_time: str = "fetched_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """``corpus_id, window, sentence_count, word_count, mean_length, fragment_rate``.

    docs: streaming ``corpus_id, doc_seq, text`` and an event time. Documents later than
    ``late`` are dropped by the watermark. Quartiles need all lengths and are left to the batch plan.
    """
    rows = docs.withWatermark(event_time, late)
    measured = measure_sentences(split_sentences(rows, ["corpus_id", event_time]))
    return (
        measured.groupBy("corpus_id", F.window(event_time, window).alias("window"))
        .agg(
            F.count(F.lit(1)).alias("sentence_count"),
            F.sum("n_words").cast("bigint").alias("word_count"),
            F.avg(F.col("n_words").cast("double")).alias("mean_length"),
            F.avg(F.when(F.col("n_words") < 5, 1.0).otherwise(0.0)).alias("fragment_rate"),
        )
    )

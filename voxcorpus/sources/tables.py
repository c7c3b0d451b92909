"""Tables as corpora."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxcorpus.functions.rows import join_on

DOCUMENT = "corpus_id string, doc_seq int, path string, title string, text string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Most keys delivered again that are sent to all tasks (some 30 MB); beyond, rows are shuffled by key.
MOST_REPEATED = 500_000


def first_delivery(df: DataFrame, key: list[str], order: str, tie: list[str] | None = None, most: int = MOST_REPEATED) -> DataFrame:
    """One row for each key, the one delivered first; null keys are a key of their own, undated rows come
    last. Of deliveries at the same time the one counts that is least by ``tie``.

    One job over the keys and times alone finds the keys that come again. If they are ``most`` or fewer, they
    are sent to all tasks, and later rows are left out where they are read: nothing else is shuffled, and no text
    but of the keys that come again at the same time. Else all rows meet by key.
    """
    first = F.min(F.struct(F.col(order).isNull().alias("undated"), F.col(order).alias("at"), F.col("_c").alias("c")))
    times = df.select(*key, order).repartition(*key).groupBy(*key, order).agg(F.count(F.lit(1)).alias("_c"))
    keys = times.groupBy(*key).agg(F.sum("_c").alias("_n"), first.alias("_f")).where("_n > 1")
    again = keys.select(*key, F.col("_f.at").alias("_first"), F.col("_f.c").alias("_same")).limit(most + 1).persist()
    n, same = again.agg(F.count(F.lit(1)), F.max("_same")).first()
    if n == 0:
        return df
    if n > most:
        again.unpersist()
        return _least(df, key, order, tie)
    marked = join_on(df, F.broadcast(again), key, "left")
    kept = marked.where(F.col("_same").isNull() | F.col(order).eqNullSafe(F.col("_first")))
    if same == 1:
        return kept.select(df.columns)
    alone = kept.where(F.coalesce("_same", F.lit(1)) == 1).select(df.columns)
    return alone.unionByName(_least(kept.where(F.col("_same") > 1).select(df.columns), key, order, tie))


def _least(df: DataFrame, key: list[str], order: str, tie: list[str] | None) -> DataFrame:
    """One exchange and one sort by the key. A row is first if none precedes it (a rank instead of the lag would
    sort all rows before the exchange too)."""
    w = Window.partitionBy(*key).orderBy(F.col(order).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie or []])
    return df.withColumn("_before", F.lag(F.lit(1)).over(w)).where(F.col("_before").isNull()).drop("_before")


def spread(df: DataFrame, key: list[str]) -> DataFrame:
    """A table that comes in fewer parts than there are cores (a small file is one part) in as many as these, so
    that what is done with its texts is not done by one task. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *key) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``corpus_id, doc_seq, path, title, text`` of documents_in; rows delivered twice count once."""
    rows = table(spark, sf_dir, "documents_in").select("corpus_id", "doc_seq", "path", "title", "text", "loaded_at")
    key = ["corpus_id", "doc_seq"]
    return spread(first_delivery(rows, key, "loaded_at", ["text"]).drop("loaded_at"), key)


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "baseline_in")


def cadence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_delivery(table(spark, sf_dir, "cadence_in"), ["corpus_id", "run_no"], "run_at")

"""Helpers the training-text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A document's key in ``documents_in``.
KEY = ["corpus_id", "doc_seq"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def first_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def in_folder(df: DataFrame, folder: str) -> DataFrame:
    """Rows with a path under ``folder``; a null path is under none."""
    return df.where(F.col("path").startswith(folder + "/"))


def web_pages(df: DataFrame) -> DataFrame:
    """Rows of websites: the first segment of the path is a host, so it has a dot."""
    return df.where(first_segment(F.col("path")).contains("."))


def website(path: Column) -> Column:
    """Host of a path, without letter case and a leading ``www.``."""
    return F.regexp_replace(F.lower(first_segment(path)), r"^www\.", "")


def flat_map(
    df: DataFrame,
    make: Callable[[], Callable[..., Iterable[tuple]]],
    schema: str,
    chunk: int = 20_000,
) -> DataFrame:
    """Arrow batches in, Arrow batches out: ``make()`` runs once in a task and gives a
    function that turns one input row (its columns as arguments) into output rows."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    width = len(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * width
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow
            )
            out.clear()
            return made

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                out.extend(one(*row))
                if len(out) >= chunk:
                    yield flush()
        if out:
            yield flush()

    return df.mapInArrow(run, struct)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table that comes in fewer parts than there are cores (a small file is one part) in as many as these, so
    that its texts are not taken apart by one task. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() * 2 <= cores else df


def salts(df: DataFrame) -> int:
    """Into how many parts the rows of a hot key are cut: as many as the cluster has cores, so that a key with
    a third of all rows keeps no task longer than others."""
    return max(16, min(1024, df.sparkSession.sparkContext.defaultParallelism))


def salted(df: DataFrame, n: int) -> DataFrame:
    """Each row once for each of the ``n`` parts, in ``salt``; for the small side of a join."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def salt_of(n: int, *keys: str) -> Column:
    """A row's part by its keys; never null, so that a join on it adds no filter that sets its two sides apart."""
    return F.coalesce(F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"), F.lit(0))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the keys appear once, as the left side has them."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])

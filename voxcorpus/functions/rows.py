"""Small helpers over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one group that are ordered within one task at a time.
SPAN = 100_000


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of ``one``, a frame of a single row (an aggregate without keys)."""
    left = df.withColumn("_one", F.lit(0))
    right = one.limit(1).withColumn("_one", F.lit(0))
    return left.join(F.broadcast(right), "_one").drop("_one")


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the keys appear once, as the left side has them."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def running(df: DataFrame, by: list[str], levels: list[Column], number: str, value: Column, name: str, span: int = SPAN) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same group that come before, in the order of
    ``levels`` (few values each) and then of the integer column ``number`` (null first).

    A group may hold a third of all rows. It is cut into spans of ``span`` numbers; rows are summed up within
    their span, the spans' totals (one row each) within the group. No task orders a whole group of rows.
    """
    ordered = [f"_l{i}" for i in range(len(levels))]
    cut = df.withColumns({c: x for c, x in zip(ordered, levels)} | {"_span": F.floor(F.col(number) / span), "_v": value})
    span_keys = [*by, *ordered, "_span"]
    totals = cut.groupBy(*span_keys).agg(F.sum("_v").alias("_t"))
    over_spans = Window.partitionBy(*by).orderBy(*ordered, "_span") if by else Window.orderBy(*ordered, "_span")
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_t").over(over_spans.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy(*span_keys).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumn("_inner", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return (
        join_on(inner, offsets.drop("_t"), span_keys)
        .withColumn(name, F.col("_offset") + F.col("_inner"))
        .drop(*ordered, "_span", "_v", "_offset", "_inner")
    )

"""Ranks inside skewed groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_total(df: DataFrame, keys: list[str], order: str, weight: Column, out: str, width: int) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the same ``keys`` up to ``order``.

    ``order`` must be an integer column, unique within ``keys``. Rows are put in
    buckets of ``width`` consecutive order values, so no task ever sorts more
    than ``width`` rows of a group however large the group is. Only one number
    per bucket is carried between buckets.
    """
    b, before = "__bucket", "__before"
    rows = df.withColumn(b, F.floor(F.col(order) / F.lit(width)).cast("long")).withColumn("__weight", weight.cast("long"))
    totals = rows.groupBy(*keys, b).agg(F.sum("__weight").alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, b, F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(*keys, b).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("__inside", F.sum("__weight").over(inside))
    return (
        ranked.join(offsets, [*keys, b])
        .withColumn(out, F.col("__inside") + F.col(before))
        .drop(b, before, "__weight", "__inside")
    )

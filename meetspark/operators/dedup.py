"""Order-preserving removal of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def keep_first(rows: DataFrame, group: list[str], key: Column, order: str) -> DataFrame:
    """The first row by ``order`` of each ``key`` within ``group``; rows with an empty or null key are dropped.

    Aggregated before the shuffle, so a hot key costs one row per task.
    """
    names = [c for c in rows.columns if c not in (*group, order, "dedup_key")]
    keyed = rows.select(*group, order, *names, key.alias("dedup_key")).where("dedup_key <> ''")
    first = keyed.groupBy(*group, "dedup_key").agg(F.min_by(F.struct(order, *names), order).alias("__first"))
    return first.select(*group, "dedup_key", "__first.*")

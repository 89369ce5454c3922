"""Pairing records with the nearest record in time (problem 5): tick expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meetspark.operators.intervals import whole_ms

TOLERANCE_MS = 1_500
#: Width of a tick, four tolerances: a right record is written to one tick and a half on average. Any width gives the same result.
TICK_MS = 6_000


def nearest_by_ticks(left: DataFrame, right: DataFrame, tolerance: int = TOLERANCE_MS, tick: int = TICK_MS) -> DataFrame:
    """``left`` (entity, l, ...) with ``r``, the nearest right time of the entity within ``tolerance``.

    ``right`` (entity, r) is expanded to every tick within the tolerance. Each
    entity and tick keeps only times that can be nearest for some time in the
    tick, each once: the last one before it, the first one behind it and those
    inside, which are at most ``tick``. The left side is then equi-joined on its
    own tick, so neither side is compared in pairs and a hot entity spreads over
    its ticks. The join is a merge of sorted rows whatever size the planner
    expects, which doesn't see that lists of times are exploded and expanded;
    on the driver such a table may not fit. Left rows without a partner, and
    rows with a null entity or time on either side, are left out; of two
    equally near times the earlier one is taken.
    """
    t = F.col("t")
    spread = (
        right.select("entity", "r")
        .where(F.col("entity").isNotNull() & F.col("r").isNotNull())
        .withColumn("t", F.explode(F.sequence(F.floor((F.col("r") - tolerance) / tick), F.floor((F.col("r") + tolerance) / tick))))
    )
    own = F.floor(F.col("r") / tick)
    kept = spread.groupBy("entity", "t").agg(
        F.max(F.when(own < t, F.col("r"))).alias("before"),
        F.min(F.when(own > t, F.col("r"))).alias("behind"),
        F.collect_set(F.when(own == t, F.col("r"))).alias("inside"),
    )
    candidates = kept.select("entity", "t", F.array_compact(F.concat(F.array("before", "behind"), "inside")).alias("near"))
    probe = left.where(F.col("entity").isNotNull() & F.col("l").isNotNull()).withColumn("t", F.floor(F.col("l") / tick))
    joined = probe.join(candidates.hint("merge"), ["entity", "t"])
    best = F.array_min(F.transform("near", lambda r: F.struct(F.abs(r - F.col("l")).alias("gap"), r.alias("r"))))
    return joined.withColumn("best", best).where(F.col("best.gap") <= tolerance).withColumn("r", F.col("best.r")).drop("t", "near", "best")


def p5_found(segments: DataFrame, diarization: DataFrame) -> DataFrame:
    """(segment_id, turn_start_ms): the turn of the same meeting that starts nearest to the segment.

    All rows of a meeting in ``diarization`` count together. Segments and turns
    without a usable start are left out; repeated rows give one row; empty
    tables give no rows.
    """
    left = segments.select("segment_id", F.col("meeting_id").alias("entity"), whole_ms(F.get("timestamp", F.lit(0))).alias("l")).distinct()
    turns = diarization.select(F.col("meeting_id").alias("entity"), F.explode("exclusive_turns").alias("turn"))
    right = turns.select("entity", whole_ms(F.col("turn.start")).alias("r"))
    return nearest_by_ticks(left, right).select("segment_id", F.col("r").alias("turn_start_ms")).distinct()

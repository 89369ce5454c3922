"""An extension: operators over turns as they arrive (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meetspark.functions import cues


def live_cue_counts(turns: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes", names: tuple[str, ...] = ("decision", "risk", "question")) -> DataFrame:
    """Cues per meeting and time window of a stream of (meeting_id, ts, text); later turns than ``late`` are dropped."""
    flagged = cues.with_cues(turns, list(names)).withWatermark(time, late)
    counts = [F.count_if(F.col(f"cue_{n}")).alias(n) for n in names]
    grouped = flagged.groupBy(F.window(time, window), "meeting_id").agg(*counts, F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("window_start"), "meeting_id", *names, "n")

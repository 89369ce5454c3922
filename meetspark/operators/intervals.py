"""Continuous periods and gaps of overlapping intervals (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meetspark.operators.ranks import running_total

#: Order values a ranking bucket spans: ten minutes in milliseconds.
BUCKET_MS = 600_000


def whole_ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds; null for null, NaN and infinite values."""
    usable = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(1e15))
    return F.when(usable, F.round(seconds * 1000).cast("long"))


def speaking_intervals(segments: DataFrame) -> DataFrame:
    """(meeting_id, speaker_id, s, e) of every row that covers some time.

    The speaker is speaker_id trimmed and in upper case, else agent, else
    ``unknown``. Rows with null, NaN or infinite start, or with null, NaN,
    infinite or non-positive duration (also after rounding) cover nothing.
    """
    named = F.upper(F.regexp_replace("speaker_id", r"(?U)^\s+|\s+$", ""))
    speaker = F.coalesce(F.when(named != "", named), F.col("agent"), F.lit("unknown"))
    start, duration = whole_ms(F.col("start")), whole_ms(F.col("duration"))
    return (
        segments.select("meeting_id", speaker.alias("speaker_id"), start.alias("s"), duration.alias("d"))
        .where(F.col("s").isNotNull() & (F.col("d") > 0))
        .select("meeting_id", "speaker_id", "s", (F.col("s") + F.col("d")).alias("e"))
    )


def _ranked_ends(intervals: DataFrame, keys: list[str], width: int) -> tuple[DataFrame, DataFrame]:
    """Starts and ends, each sorted and ranked on its own within ``keys``.

    Intervals sharing a start are first reduced to the longest one, so repeated
    rows shrink before any ranking. ``starts`` has one row per start with its
    rank ``r``; ``ends`` has one row per end value with the rank ``r`` of the
    last interval that ends there.
    """
    distinct = intervals.groupBy(*keys, "s").agg(F.max("e").alias("e"))
    starts = running_total(distinct.select(*keys, "s"), keys, "s", F.lit(1), "r", width)
    counted = distinct.groupBy(*keys, "e").agg(F.count("*").alias("n"))
    ends = running_total(counted, keys, "e", F.col("n"), "r", width).drop("n")
    return starts, ends


def gaps(intervals: DataFrame, keys: list[str], width: int = BUCKET_MS) -> DataFrame:
    """(keys, gap_start, gap_end): maximal uncovered stretches between covered ones.

    Starts and ends are sorted independently; a gap lies between the end ranked
    i and the start ranked i + 1 exactly where that start is later. Touching
    intervals leave no gap. Null keys form groups of their own. An entity
    without or with one interval has no gap.
    """
    starts, ends = _ranked_ends(_filled(intervals, keys), _hashed(keys), width)
    following = starts.select(*_hashed(keys), F.col("s").alias("gap_end"), (F.col("r") - 1).alias("r"))
    found = ends.join(following, [*_hashed(keys), "r"]).where(F.col("gap_end") > F.col("e"))
    return found.select(*_restored(keys), F.col("e").alias("gap_start"), "gap_end")


def periods(intervals: DataFrame, keys: list[str], width: int = BUCKET_MS) -> DataFrame:
    """(keys, period_start, period_end): the continuous covered periods.

    A period starts at the first start or behind a gap and ends at the last end
    or before a gap; starts and ends are ranked once more and paired by rank.
    """
    hk = _hashed(keys)
    starts, ends = _ranked_ends(_filled(intervals, keys), hk, width)
    opening = starts.alias("a").join(
        ends.select(*hk, "e", (F.col("r") + 1).alias("r")), [*hk, "r"], "left"
    ).where((F.col("r") == 1) | (F.col("e") < F.col("s")))
    closing = ends.alias("a").join(
        starts.select(*hk, "s", (F.col("r") - 1).alias("r")), [*hk, "r"], "left"
    )
    last = starts.groupBy(*hk).agg(F.max("r").alias("n"))
    closing = closing.join(last, hk).where((F.col("r") == F.col("n")) | (F.col("e") < F.col("s")))
    first = running_total(opening.select(*hk, F.col("s").alias("period_start")), hk, "period_start", F.lit(1), "k", width)
    final = running_total(closing.select(*hk, F.col("e").alias("period_end")), hk, "period_end", F.lit(1), "k", width)
    return first.join(final, [*hk, "k"]).select(*_restored(keys), "period_start", "period_end")


def _hashed(keys: list[str]) -> list[str]:
    return [f"__k_{k}" for k in keys]


def _filled(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys as one-element arrays, so that null keys take part in plain equi-joins."""
    return df.select(*[F.array(k).alias(h) for k, h in zip(keys, _hashed(keys))], "s", "e")


def _restored(keys: list[str]) -> list[Column]:
    return [F.col(h)[0].alias(k) for k, h in zip(keys, _hashed(keys))]


def p2_found(segments: DataFrame) -> DataFrame:
    """(meeting_id, speaker_id, gap_start_ms, gap_end_ms) of every silent gap.

    An empty table gives no rows; repeated rows change nothing; other columns
    of ``segments`` are ignored.
    """
    found = gaps(speaking_intervals(segments), ["meeting_id", "speaker_id"])
    return found.select("meeting_id", "speaker_id", F.col("gap_start").alias("gap_start_ms"), F.col("gap_end").alias("gap_end_ms"))


def p2_periods(segments: DataFrame) -> DataFrame:
    """(meeting_id, speaker_id, period_start_ms, period_end_ms) of every speaking period."""
    found = periods(speaking_intervals(segments), ["meeting_id", "speaker_id"])
    return found.select(
        "meeting_id", "speaker_id", F.col("period_start").alias("period_start_ms"), F.col("period_end").alias("period_end_ms")
    )

from __future__ import annotations

import random

from conftest import rows
from pyspark.sql import functions as F

from meetspark.operators import intervals
from meetspark.operators.ranks import running_total

SCHEMA = "meeting_id string, agent string, speaker_id string, start double, duration double, s long, gap_start_ms long"


def brute(items):
    """Gaps and periods of (key, s, e) by walking along time."""
    gaps, periods, by = set(), set(), {}
    for k, s, e in items:
        by.setdefault(k, []).append((s, e))
    for k, own in by.items():
        own.sort()
        low, high = own[0]
        for s, e in own[1:]:
            if s > high:
                gaps.add((*k, high, s))
                periods.add((*k, low, high))
                low, high = s, e
            high = max(high, e)
        periods.add((*k, low, high))
    return gaps, periods


def test_random_against_brute_force(spark):
    rng = random.Random(1)
    items = [(f"m{rng.randrange(3)}", rng.choice("AB"), rng.randrange(0, 4000), rng.randrange(1, 60)) for _ in range(400)]
    items += items[:50]
    given = spark.createDataFrame([(m, a, None, s / 1000, d / 1000, 7, 7) for m, a, s, d in items], SCHEMA)
    gaps, periods = brute([((m, a), s, s + d) for m, a, s, d in items])
    found = intervals.speaking_intervals(given)
    for width in (1, 37, intervals.BUCKET_MS):  # whatever the buckets, the result is the same
        got = rows(intervals.gaps(found, ["meeting_id", "speaker_id"], width))
        assert set(got) == gaps and len(got) == len(gaps)
        assert set(rows(intervals.periods(found, ["meeting_id", "speaker_id"], width))) == periods


def test_speakers_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    given = spark.createDataFrame(
        [
            ("m", "A", " mx1 ", 0.0, 1.0, 1, 1), ("m", "B", "MX1", 2.0, 1.0, 1, 1),  # one speaker, a gap from 1 s to 2 s
            ("m", "A", "MX1", 1.2, None, 1, 1), ("m", "A", "MX1", 1.2, -1.0, 1, 1), ("m", "A", "MX1", 1.2, 0.0, 1, 1), ("m", "A", "MX1", 1.2, nan, 1, 1),
            ("m", "A", "MX1", nan, 1.0, 1, 1), ("m", "A", "MX1", None, 1.0, 1, 1), ("m", "A", "MX1", inf, 1.0, 1, 1), ("m", "A", "MX1", 1.2, 0.0001, 1, 1),
            ("m", "A", "", 0.0, 1.0, 1, 1), ("m", "A", None, 1.0, 1.0, 1, 1), ("m", "A", "  ", 3.0, 1.0, 1, 1),  # touch, then a gap
            ("m", None, None, 0.0, 0.5, 1, 1), (None, None, None, 0.0, 0.5, 1, 1), (None, None, None, 0.7, 0.5, 1, 1),
        ],
        SCHEMA,
    )
    want = [("m", "A", 2000, 3000), ("m", "MX1", 1000, 2000), (None, "unknown", 500, 700)]
    assert rows(intervals.p2_found(given)) == sorted(want, key=repr)
    assert ("m", "unknown", 0, 500) in rows(intervals.p2_periods(given))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rows(intervals.p2_found(none)) == [] and rows(intervals.p2_periods(none)) == []


def test_running_total(spark):
    given = spark.range(-50, 50).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    got = rows(running_total(given, ["k"], "v", F.lit(2), "t", 7), "v", "t")
    assert sorted(got) == [(v, 2 * (i + 1)) for i, v in enumerate(range(-50, 50))]


def test_no_task_sorts_a_whole_group(spark):
    """A speaker holding all rows is ranked in as many groups as it has buckets."""
    given = spark.range(5000).select(F.lit("m").alias("meeting_id"), F.lit("A").alias("agent"), F.lit(None).cast("string").alias("speaker_id"), (F.col("id") * 2.0).alias("start"), F.lit(1.0).alias("duration"))
    assert intervals.p2_found(given).count() == 4999

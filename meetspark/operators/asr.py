"""Speech recognition output: coverage, unreliable segments, merging of passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meetspark.functions.text import normalised_segment_text, quality_cap, tokens

#: Fixed values.
LOW_WPM, CRITICAL_WPM, LONG_S = 100.0, 80.0, 120.0
MIN_LOGPROB, MAX_NO_SPEECH, SILENCE_LOGPROB, MAX_COMPRESSION = -1.0, 0.65, -0.55, 2.4


def coverage(segments: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Words, words per minute, covered share and status of each meeting.

    The duration is that of ``durations`` (meeting_id, duration_s) where it is
    positive, else the last end.
    """
    rows = segments.groupBy("meeting_id").agg(
        F.max("end_s").alias("last_end"), F.sum(F.size(tokens(F.col("text")))).alias("word_count"), F.sum(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))).alias("covered")
    )
    if durations is not None:
        rows = rows.join(durations, "meeting_id", "left")
        rows = rows.withColumn("duration_s", F.when(F.col("duration_s") > 0, F.col("duration_s")).otherwise(F.col("last_end")))
    else:
        rows = rows.withColumn("duration_s", F.col("last_end"))
    wpm = F.col("word_count") / F.greatest(F.col("duration_s") / 60, F.lit(1 / 60))
    long = F.col("duration_s") >= LONG_S
    rows = rows.withColumn("wpm", wpm).withColumn("low", long & (F.col("wpm") < LOW_WPM)).withColumn("critical", long & (F.col("wpm") < CRITICAL_WPM))
    status = F.when(F.col("critical"), "critical").when(F.col("low"), "review").otherwise("good")
    share = F.least(F.lit(1.0), F.col("covered") / F.greatest("duration_s", F.lit(0.001)))
    return rows.select("meeting_id", "duration_s", "word_count", "wpm", share.alias("covered_share"), "low", "critical", status.alias("status"), quality_cap(F.col("low"), F.col("critical")).alias("quality"))


def reliability(segments: DataFrame) -> DataFrame:
    """Each segment with its reasons for rejection, in fixed order; the array is empty for kept ones.

    A repeated phrase is the third or later occurrence of the same words, of
    four words or more; rejected segments count as occurrences.
    """
    key = normalised_segment_text(F.col("text"))
    seen = Window.partitionBy("meeting_id", "text_key").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = segments.withColumn("text_key", key).withColumn("occurrence", F.count("*").over(seen))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("avg_logprob") < MIN_LOGPROB, "low_log_probability"),
            F.when((F.col("no_speech_prob") > MAX_NO_SPEECH) & (F.col("avg_logprob") < SILENCE_LOGPROB), "probable_silence"),
            F.when(F.col("compression_ratio") > MAX_COMPRESSION, "repetitive_compression"),
            F.when((F.col("text_key") != "") & (F.col("occurrence") > 2) & (F.size(F.split("text_key", " ")) >= 4), "repeated_phrase"),
        )
    )
    return rows.withColumn("reasons", reasons)


def recovery_candidates(base: DataFrame, recovery: DataFrame, cell: float = 60.0) -> DataFrame:
    """Rows of a second pass that may fill a gap of the first one.

    Left out are rows whose words stand in the first pass, rows more than five
    seconds outside of it (if it has two rows or more) and rows that a base row
    covers by a quarter or more. Meetings without a first pass keep all rows.
    """
    rows = recovery.withColumn("text_key", normalised_segment_text(F.col("text"))).where("text_key <> ''")
    first = base.withColumn("text_key", normalised_segment_text(F.col("text")))
    bounds = first.groupBy("meeting_id").agg(F.min("start_s").alias("low"), F.max("end_s").alias("high"), F.count("*").alias("n"))
    fresh = rows.join(first.select("meeting_id", "text_key").distinct(), ["meeting_id", "text_key"], "left_anti").join(bounds, "meeting_id", "left")
    inside = fresh.where("n IS NULL OR n < 2 OR NOT (end_s < low - 5.0 OR start_s > high + 5.0)").drop("low", "high", "n")
    cells = lambda df: df.withColumn("cell", F.explode(F.sequence(F.floor(F.least("start_s", "end_s") / cell), F.floor(F.greatest("start_s", "end_s") / cell))))
    spans = cells(first.select("meeting_id", "start_s", "end_s")).select("meeting_id", "cell", F.col("start_s").alias("s"), F.col("end_s").alias("e"))
    overlap = F.greatest(F.lit(0.0), F.least("end_s", "e") - F.greatest("start_s", "s")) / F.greatest(F.lit(0.001), F.col("end_s") - F.col("start_s"))
    covered = cells(inside.select("meeting_id", "idx", "start_s", "end_s")).join(spans, ["meeting_id", "cell"]).where(overlap >= 0.25).select("meeting_id", "idx").distinct()
    return inside.join(covered, ["meeting_id", "idx"], "left_anti")


#: How many times the first pass's words a second pass must reach to be taken. Fixed value.
IMPROVEMENT = 1.05


def choose_pass(first: DataFrame, second: DataFrame, durations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, attempts): of each meeting the first pass, or both passes merged where that is better.

    Both sides: meeting_id, idx, text, start_s, end_s and the measures that
    reliability reads; unreliable rows of either are left out. Only meetings
    whose first pass covers too little are tried again. The merged pass is taken
    if it has at least one word more, and 1.05 times as many. attempts has
    meeting_id, strategy, word_count, selected and coverage_status.
    """
    from meetspark.operators.greedy import merge_passes

    columns = ["meeting_id", "text", "start_s", "end_s"]
    usable = lambda df: reliability(df).where(F.size("reasons") == 0)
    base = usable(first)
    own = coverage(base, durations)
    low = own.where("low").select("meeting_id")
    weak = base.join(low, "meeting_id", "left_semi")
    merged = merge_passes(weak, recovery_candidates(weak, usable(second).join(low, "meeting_id", "left_semi")))
    hybrid = coverage(merged, durations)
    compared = own.select("meeting_id", F.col("word_count").alias("n")).join(hybrid.select("meeting_id", F.col("word_count").alias("m")), "meeting_id", "left")
    better = F.coalesce(F.col("m") >= F.greatest(F.col("n") + 1, F.floor(F.col("n") * IMPROVEMENT)), F.lit(False))
    chosen = compared.select("meeting_id", better.alias("better"))
    kept = base.select(*columns, F.lit("vad").alias("origin")).join(chosen.where("NOT better"), "meeting_id", "left_semi").unionByName(merged.join(chosen.where("better"), "meeting_id", "left_semi").select(*columns, "origin"))
    attempts = own.join(chosen, "meeting_id").select("meeting_id", F.lit("vad").alias("strategy"), "word_count", (~F.col("better")).alias("selected"), F.col("status").alias("coverage_status")).unionByName(
        hybrid.join(chosen, "meeting_id").select("meeting_id", F.lit("hybrid").alias("strategy"), "word_count", F.col("better").alias("selected"), F.col("status").alias("coverage_status"))
    )
    return kept, attempts


def review_needed(attempts: DataFrame) -> DataFrame:
    """(meeting_id, needed): whether the chosen pass covers so little that somebody has to agree before it is used."""
    return attempts.where("selected").select("meeting_id", (F.col("coverage_status") == "critical").alias("needed"))

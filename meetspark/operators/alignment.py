"""Speakers for segments: interval overlap, positional and fuzzy reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meetspark.functions.text import clean_text, format_timestamp, seconds

#: Width of the time cells that make the overlap join an equi-join.
CELL_S = 60.0


def assign_speakers(segments: DataFrame, turns: DataFrame, cell: float = CELL_S) -> DataFrame:
    """Each segment with the speaker of the greatest total overlap, else ``SPEAKER_UNKNOWN``.

    ``segments``: meeting_id, idx, start_s, end_s; ``turns``: meeting_id, idx, s, e,
    speaker. Bounds given the wrong way round are swapped. Of equal overlaps the
    speaker whose first turn comes first counts. Both sides are spread over the
    time cells they touch, so a long meeting is joined cell by cell and never
    turn by turn; a pair that shares several cells counts in the first one only.
    Segments without times stay, unknown; turns without times or speaker are left out.
    """
    low, high = F.least("start_s", "end_s"), F.greatest("start_s", "end_s")
    left = segments.select("meeting_id", "idx", low.alias("a"), high.alias("b"))
    right = turns.where("s < e AND speaker IS NOT NULL").select("meeting_id", "s", "e", "speaker", F.col("idx").alias("turn_idx"))
    first = right.groupBy("meeting_id", "speaker").agg(F.min("turn_idx").alias("first_turn"))
    cells = lambda x, y: F.explode(F.sequence(F.floor(x / cell), F.floor(y / cell)))
    near = left.where("a IS NOT NULL AND b IS NOT NULL").withColumn("cell", cells(F.col("a"), F.col("b"))).join(
        right.withColumn("cell", cells(F.col("s"), F.col("e"))), ["meeting_id", "cell"]
    )
    shared = F.least("b", "e") - F.greatest("a", "s")
    met = near.where((shared > 0) & (F.col("cell") == F.floor(F.greatest("a", "s") / cell)))
    totals = met.groupBy("meeting_id", "idx", "speaker").agg(F.sum(shared).alias("overlap")).join(first, ["meeting_id", "speaker"])
    best = totals.groupBy("meeting_id", "idx").agg(F.max(F.struct("overlap", (-F.col("first_turn")).alias("order"), "speaker")).alias("best"))
    joined = segments.drop("speaker").join(best, ["meeting_id", "idx"], "left")
    return joined.select(
        *[c for c in segments.columns if c not in ("speaker", "best")],
        F.coalesce("best.speaker", F.lit("SPEAKER_UNKNOWN")).alias("speaker"),
        F.coalesce("best.overlap", F.lit(0.0)).alias("overlap_s"),
    )


def speaker_transcript(segments: DataFrame) -> DataFrame:
    """(meeting_id, transcript): ``[time] speaker: text`` lines in order."""
    line = F.concat(F.lit("["), format_timestamp(F.coalesce("start_s", F.lit(0.0))), F.lit("] "), F.coalesce("speaker", F.lit("SPEAKER_UNKNOWN")), F.lit(": "), clean_text(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))
    return segments.groupBy("meeting_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("transcript"))


def parse_transcript(texts: DataFrame, key: str = "meeting_id", text: str = "transcript") -> DataFrame:
    """(key, idx, speaker, text, start_s) of each non-empty turn of a plain transcript.

    A text of a single line is cut before each ``SPEAKER_x:``. A line may begin
    with ``[H:MM:SS]`` and a speaker of up to 80 characters before a colon. Null
    and blank texts have no turns.
    """
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    lines = F.filter(F.transform(F.split(body, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), F.trim), lambda x: x != "")
    single = F.filter(F.transform(F.split(lines[0], r"(?=\bSPEAKER_[A-Za-z0-9_-]+\s*:)"), F.trim), lambda x: x != "")
    cut = F.when((F.size(lines) == 1) & (F.size(single) > 1), single).otherwise(lines)
    given = texts.select(key, F.posexplode(cut).alias("pos", "line"))
    clock = r"^\[(\d{1,2}:\d{2}:\d{2}(?:\.\d+)?)\]\s*(.+)$"
    timed = F.regexp_extract("line", clock, 1)
    rest = F.when(timed != "", F.trim(F.regexp_extract("line", clock, 2))).otherwise(F.col("line"))
    named = r"^([^:\n]{1,80}):\s*(.+)$"
    given = given.withColumn("rest", rest).withColumn("start_s", F.when(timed != "", seconds(timed)))
    who = F.regexp_extract("rest", named, 1)
    spoken = F.when(who != "", F.regexp_extract("rest", named, 2)).otherwise(F.col("rest"))
    turns = given.select(key, "pos", F.when(who != "", clean_text(who)).alias("speaker"), clean_text(spoken).alias("text"), "start_s").where("text <> ''")
    return turns.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).drop("pos")


def audio_segments(results: DataFrame) -> DataFrame:
    """(meeting_id, pos, speaker, text, start_s, end_s) from speech results.

    ``results`` has meeting_id, speaker_segments (start, end, speaker, text) and
    segments (text, timestamp); the former are used where there are any.
    """
    attributed = F.transform("speaker_segments", lambda s: F.struct(F.nullif(clean_text(s["speaker"]), F.lit("")).alias("speaker"), clean_text(s["text"]).alias("text"), s["start"].alias("start_s"), s["end"].alias("end_s")))
    plain = F.transform("segments", lambda s: F.struct(F.lit(None).cast("string").alias("speaker"), clean_text(s["text"]).alias("text"), F.get(s["timestamp"], F.lit(0)).alias("start_s"), F.get(s["timestamp"], F.lit(1)).alias("end_s")))
    chosen = F.when(F.size(F.coalesce("speaker_segments", F.array())) > 0, attributed).otherwise(plain)
    rows = results.select("meeting_id", F.posexplode(chosen).alias("pos", "s"))
    return rows.select("meeting_id", "pos", "s.*").where("text <> ''")


def positional_reconcile(parsed: DataFrame, audio: DataFrame) -> DataFrame:
    """Times and missing speakers by position, for meetings with as many parsed turns as audio segments."""
    counts = parsed.groupBy("meeting_id").count().join(audio.groupBy("meeting_id").agg(F.count("*").alias("n")), "meeting_id").where("count = n").select("meeting_id")
    other = audio.select("meeting_id", "idx", F.col("speaker").alias("other"), F.col("start_s").alias("s"), F.col("end_s").alias("e"))
    joined = parsed.drop("start_s", "end_s").join(counts, "meeting_id", "left_semi").join(other, ["meeting_id", "idx"])
    return joined.select("meeting_id", "idx", F.coalesce("speaker", "other").alias("speaker"), "text", F.col("s").alias("start_s"), F.col("e").alias("end_s"))


def dense_ids(segments: DataFrame, order: list[Column]) -> DataFrame:
    """idx from 0 and seg_id ``seg-0001`` by ``order`` within the meeting, and the origin of each segment."""
    ranked = segments.withColumn("idx", F.row_number().over(Window.partitionBy("meeting_id").orderBy(*order)) - 1)
    return ranked.withColumn("seg_id", F.format_string("seg-%04d", F.col("idx") + 1)).withColumn("origin", F.when(F.col("start_s").isNotNull(), "audio").otherwise("transcript"))


def combine(segments: DataFrame, turns: DataFrame, runs: DataFrame) -> DataFrame:
    """Segments with the speakers of their meeting's turns, and a note where finding speakers failed.

    ``runs``: meeting_id, error. Segments of a meeting whose run failed, or that
    has none, stay with a null speaker, so no transcript is lost.
    """
    state = runs.groupBy("meeting_id").agg(F.max(F.col("error").isNull()).alias("ok"), F.max("error").alias("error"))
    joined = segments.drop("speaker").join(state, "meeting_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    done = assign_speakers(joined.where("ok").drop("ok", "error"), turns).withColumn("note", F.lit(None).cast("string"))
    reason = F.coalesce("error", F.lit("no speaker turns"))
    rest = joined.where("NOT ok").withColumns({"speaker": F.lit(None).cast("string"), "overlap_s": F.lit(0.0), "note": F.concat(F.lit("Speakers unavailable: "), reason)})
    return done.unionByName(rest.select(*done.columns))


def rename_speakers(turns: DataFrame, names: DataFrame) -> DataFrame:
    """Turns under the names given for their speakers; ``names``: meeting_id, speaker, name. Blank names change nothing; of several the largest counts."""
    given = names.withColumn("name", clean_text(F.col("name"))).where("name <> ''").groupBy("meeting_id", "speaker").agg(F.max("name").alias("__name"))
    return turns.join(given, ["meeting_id", "speaker"], "left").withColumn("speaker", F.coalesce("__name", "speaker")).drop("__name")


def rename_in_text(transcript: Column, names: Column) -> Column:
    """A transcript with ``SPEAKER:`` labels renamed by an array of structs of speaker and name, in its order."""
    quoted = lambda s: F.concat(F.lit(r"\b\Q"), s, F.lit(r"\E(?=:)"))
    plain = lambda s: F.regexp_replace(s, r"([\\$])", r"\\$1")
    used = F.filter(names, lambda n: clean_text(n["name"]) != "")
    return F.aggregate(used, transcript, lambda text, n: F.regexp_replace(text, quoted(n["speaker"]), plain(clean_text(n["name"]))))


def take_audio(parsed: DataFrame, audio: DataFrame, same: float = 0.95) -> DataFrame:
    """(meeting_id): meetings whose transcript is one parsed line that says what several audio segments say together.

    Their audio segments stand for the line. Both sides: meeting_id, idx, text.
    """
    from meetspark.functions.similarity import evidence_similarity

    one = parsed.groupBy("meeting_id").agg(F.count("*").alias("n"), F.first("text").alias("line")).where("n = 1")
    told = audio.groupBy("meeting_id").agg(F.count("*").alias("m"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("said")).where("m > 1")
    return one.join(told, "meeting_id").where(evidence_similarity(F.col("line"), F.col("said")) >= same).select("meeting_id")

"""What turns say outright: tasks, the meeting's purpose, planned talks and who introduced themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meetspark.functions import cues
from meetspark.functions.similarity import evidence_similarity
from meetspark.functions.text import clean_text, content_tokens, let, normalise_role, tokens

#: Where a task starts in a turn; the first pattern that matches counts. Fixed values.
TASK_STARTS = [
    r"\bask(?:ed|ing)? (?:me|us|you|him|her|them) to\s+(.+)$", r"\byou\s+(?:could(?: always)?|should|might(?: want to)?|need to)\s+(.+)$", r"\b(?:maybe\s+)?we can\s+(.+)$",
    r"\bwhy don't we\s+(.+)$", r"\bi will\s+(?:have time to\s+)?(.+)$", r"\bi'll\s+(.+)$", r"^will\s+(?:have time to\s+)?(.+)$",
]
#: What is cut off a task. Fixed values.
TASK_CUTS = [
    r"^(?:yeah|okay|well|but|so|anyway)[, ]+", r"^you to (?=(?:check|confirm|email|include|review|revise|send|share|update)\b)", r"\s+you had\b.*$", r"\s+(?:and|or|the|a|an|to|of|for|with)$",
]
NO_TASK = r"^(?:the problem is|for the most frequent case|nothing i want|thank you[, ]+mr\.? chair|good morning[, ]+mr\.? chair)\b"
TASK_WORDS, TASK_CHARACTERS = 32, 180
#: How a purpose is worded. Fixed values.
DESIGNING = r"\b(?:we(?:'re| are)\s+)?designing\s+(?:a|the)\s+(.+?)(?:[.?!]|$)"
ABOUT = r"\b(?:talking about|discussion is about|meeting is about|focused on)\s+(.+?)(?:\s+today\b|[.?!]|$)"
KICK_OFF = r"\bkick[- ]off meeting\b"
VENUE = r"\b(?:talk|presentation)\s+(?:at|for)\s+([A-Za-z][\w-]{1,30})"
#: How far behind a kick-off a purpose is looked for, and from what ratio on two topics are one. Fixed values.
LOOK_AHEAD, SAME_TOPIC = 24, 0.68
#: What the topics found here are worth. Fixed values.
CONFIDENCE, BOOST = 0.75, 0.40


def _i(pattern: str) -> Column:
    return F.lit("(?iU)" + pattern)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"[ ,;:-]+$", "")


def _vetoed(text: Column, *names: str) -> Column:
    out = cues.has(text, names[0])
    for n in names[1:]:
        out = out | cues.has(text, n)
    return out


def clean_action_task(value: Column) -> Column:
    """A quoted follow-up as a concise task; '' where it is negated, past, housekeeping, a mere question, too long or too thin."""
    return let(F.regexp_replace(_trimmed(clean_text(value)), r"^[ ,;:-]+", ""), _task)


def _task(said: Column) -> Column:
    started = [let(F.regexp_extract(said, "(?iU)" + pattern, 1), lambda t: F.when(t != "", t)) for pattern in TASK_STARTS]
    task = clean_text(F.coalesce(*started, said))
    for pattern in TASK_CUTS:
        task = F.regexp_replace(task, _i(pattern), F.lit(""))
    return let(task, lambda t: _fit(said, t))


def _fit(said: Column, task: Column) -> Column:
    """``task`` with a capital; '' where what was said or the task rules it out."""
    bad = (
        _vetoed(said, "negated_action", "past_activity", "non_followup", "non_action") | _vetoed(task, "non_followup", "non_action")
        | (F.contains(task, F.lit("?")) & ~cues.has(task, "direct_request")) | (F.size(tokens(task)) > TASK_WORDS) | F.regexp_like(task, _i(NO_TASK)) | (F.size(content_tokens(task)) < 2)
    )
    upper = F.concat(F.upper(F.substring(task, 1, 1)), F.substring(task, F.lit(2), F.length(task)))
    return F.when(bad, F.lit("")).otherwise(_trimmed(F.substring(upper, 1, TASK_CHARACTERS)))


def purpose_topic(text: Column) -> Column:
    """The topic a turn names as the meeting's purpose; '' if it names none."""
    made = clean_text(F.regexp_extract(text, "(?iU)" + DESIGNING, 1))
    design = F.concat(F.upper(F.substring(made, 1, 1)), F.lower(F.substring(made, F.lit(2), F.length(made))), F.lit(" design"))
    about = F.regexp_replace(clean_text(F.regexp_extract(text, "(?iU)" + ABOUT, 1)), _i(r"^(?:the\s+)?(?:topic of\s+)?"), F.lit(""))
    words = F.size(F.split(about, " "))
    return (
        F.when(made != "", F.substring(design, 1, 100))
        .when(F.regexp_like(text, _i(ABOUT)), F.when(words.between(2, 14), _trimmed(F.substring(about, 1, 100))).otherwise(""))
        .when(F.regexp_like(text, _i(KICK_OFF)), "Project kick-off")
        .otherwise("")
    )


def structural_topics(segments: DataFrame) -> DataFrame:
    """(meeting_id, text, source, confidence, boost, idx, seg_id): at most one purpose and one planned talk per meeting.

    A bare kick-off gives way to the first more specific purpose among the 24
    turns behind it. The purpose is the first purpose turn with a topic; the
    talk is the first turn that plans one and isn't that purpose.
    """
    text = clean_text(F.col("text"))
    along = Window.partitionBy("meeting_id").orderBy("idx")
    rows = segments.withColumns({"topic": purpose_topic(text), "is_purpose": cues.has(text, "purpose"), "is_talk": cues.has(text, "presentation"), "venue": F.regexp_extract(text, "(?iU)" + VENUE, 1)})
    specific = (F.col("topic") != "") & (F.col("topic") != "Project kick-off")
    ahead = F.first(F.when(specific, F.struct("topic", "idx", "seg_id")), True).over(along.rowsBetween(1, LOOK_AHEAD))
    own = F.struct("topic", "idx", "seg_id")
    rows = rows.withColumn("found", F.when(F.col("topic") == "Project kick-off", F.coalesce(ahead, own)).otherwise(own))
    purposes = rows.where(F.col("is_purpose") & (F.col("topic") != "")).groupBy("meeting_id").agg(F.min_by(F.struct("found", F.col("idx").alias("at")), "idx").alias("p"))
    first = purposes.select("meeting_id", F.col("p.found.topic").alias("text"), F.lit("deterministic_purpose_recovery").alias("source"), F.col("p.found.idx").alias("idx"), F.col("p.found.seg_id").alias("seg_id"))
    label = F.when(F.col("venue") != "", F.concat("venue", F.lit(" presentation"))).otherwise("Planned presentation")
    talks = rows.where("is_talk").join(purposes.select("meeting_id", F.col("p.at").alias("idx")), ["meeting_id", "idx"], "left_anti")
    planned = talks.groupBy("meeting_id").agg(F.min_by(F.struct(label.alias("text"), "idx", "seg_id"), "idx").alias("t")).select("meeting_id", "t.text", F.lit("deterministic_presentation_recovery").alias("source"), "t.idx", "t.seg_id")
    return first.unionByName(planned).withColumns({"confidence": F.lit(CONFIDENCE), "boost": F.lit(BOOST)})


def new_topics(found: DataFrame, topics: DataFrame) -> DataFrame:
    """The rows of ``found`` that no topic of the meeting resembles by 0.68 or more."""
    other = topics.select("meeting_id", F.col("text").alias("__topic"))
    known = found.join(other, "meeting_id").where(evidence_similarity(F.col("__topic"), F.col("text")) >= SAME_TOPIC).select("meeting_id", "text").distinct()
    return found.join(known, ["meeting_id", "text"], "left_anti")


def introductions(segments: DataFrame) -> DataFrame:
    """(meeting_id, speaker, name, role, seg_id): who introduced themselves with a role; a speaker's last introduction counts.

    The role must stand behind the name. Words such as pronouns are no names.
    """
    text = clean_text(F.col("text"))
    whole = F.regexp_substr(text, F.lit(cues.java("introduction")))
    name = F.regexp_extract(text, cues.java("introduction"), 1)
    behind = F.substring(text, F.regexp_instr(text, F.lit(cues.java("introduction"))) + F.length(whole), F.length(text))
    rows = segments.withColumns({"name": name, "role": F.regexp_extract(behind, cues.java("role"), 1)})
    kept = rows.where((F.col("name") != "") & ~F.lower("name").isin(cues.NOT_NAMES) & (F.col("role") != "") & F.col("speaker").isNotNull() & ~F.lower("speaker").isin("", "unknown", "speaker_unknown"))
    last = kept.groupBy("meeting_id", "speaker").agg(F.max_by(F.struct("name", "role", "seg_id"), "idx").alias("l"))
    return last.select("meeting_id", "speaker", "l.name", normalise_role(F.col("l.role")).alias("role"), "l.seg_id")


def same_speaker_continuations(segments: DataFrame, gap_s: float = 15.0) -> DataFrame:
    """(meeting_id, idx, next_idx): turns the same speaker may go on with, among the two behind, at most ``gap_s`` later."""
    along = Window.partitionBy("meeting_id").orderBy("idx")
    rows = segments
    for k in (1, 2):
        rows = rows.withColumn(f"n{k}", F.lead(F.struct("idx", "speaker", "start_s", "end_s"), k).over(along))
    end = F.coalesce(F.when(F.col("end_s") != 0, F.col("end_s")), F.col("start_s"))
    close = lambda a, b: F.coalesce(b <= a + gap_s, F.lit(True))
    one = (F.col("n1.speaker") == F.col("speaker")) & close(end, F.col("n1.start_s"))
    two = one & (F.col("n2.speaker") == F.col("speaker")) & close(end, F.col("n2.start_s"))
    steps = F.array_compact(F.array(F.when(one, F.col("n1.idx")), F.when(two, F.col("n2.idx"))))
    return rows.select("meeting_id", "idx", F.explode(steps).alias("next_idx"))

"""A cue-rich view of meeting segments made from ``events``, the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meetspark.runtime import table

_TEXTS = [
    "One two three microphone test, can you hear me?", "Today we are talking about the delivery plan for zone {N}.", "I am going to present a little talk at Lyon about it.",
    "That was a great story about the trip.", "The main takeaway is overall cost per order.", "We agreed to go with supplier {N} for the launch.", "The customs delay is a risk for order {N}.",
    "Which carrier should we use for order {N}?", "The budget target is {N} and it must hold.", "I am Nadia, and I am the project manager.", "My name is Oskar, and I am the marketing expert.",
    "The device must be user-friendly for the market.", "Am I supposed to be sitting down near the camera?", "Just to wrap up, the next meeting is on day {N}.", "I will check whether there is anything else.",
    "If people need it, send the form to them.", "I do not think we can send report {N} today.", "What I did was review the earlier report.", "Priya will send report {N} by Monday.", "Tomas, please review invoice {N} by Friday.",
    "I will prepare the summary of order {N}.", "Could you share the price list {N} again?", "They asked me to schedule visit {N}.", "They will deliver pallet {N} next week.", "You might want to double-check figure {N}.",
    "We are selling this for {N} euro.", "The profit target is {N} million euro.", "The production cost is {N} euro.", "We plan to sell this internationally.", "It must be usable by all age groups.", "How many should we sell then?",
    "Two million, no, four million.", "As the industrial designer, you are going to be working on the physical design.", "Marketing manager, you will be thinking about the user requirements.",
    "The product is supposed to be light, bright and sturdy.", "Background discussion item {N} about the product layout.", "Background discussion item {N} about the product layout and packing.", "Okay then.",
    "That is Nadia, Oskar, and Priya.", "Please send the", "send the signed form to the office.", "The room is still unconfirmed, so that is unresolved.", "We are designing a folding crate today.", "Sales moved {N} units between depots last month.",
]

SEGMENTS = (
    "SELECT meeting_id, idx, concat('seg-', lpad(CAST(idx + 1 AS STRING), 4, '0')) AS seg_id, speaker, text, "
    "CAST(idx * 8 + (event_id % 5) * 0.5 AS DOUBLE) AS start_s, CAST(idx * 8 + (event_id % 5) * 0.5 + 2 + event_id % 7 AS DOUBLE) AS end_s, "
    "event_id, CAST(-(event_id * 7 % 20) AS DOUBLE) / 10 AS avg_logprob, CAST(event_id * 13 % 100 AS DOUBLE) / 100 AS no_speech_prob, "
    "1 + CAST(event_id * 11 % 20 AS DOUBLE) / 10 AS compression_ratio FROM ("
    "SELECT user_id AS meeting_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS idx, "
    "concat('SPEAKER_0', CAST(event_id % 4 AS STRING)) AS speaker, replace(txt, '{N}', CAST(CAST(floor(value) AS INT) AS STRING)) AS text, event_id "
    "FROM EVENTS_TABLE JOIN (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(_TEXTS)) + ") tpl(k, txt) ON (event_id * 31 + user_id) % 44 = k) seg"
)
#: Start of every oracle over segments: the views seg and turn.
WITH = (
    f"WITH seg AS ({SEGMENTS.replace('EVENTS_TABLE', 'events')}), turn AS (SELECT meeting_id, idx, start_s - 1.5 AS s, end_s - 3.0 AS e, "
    "concat('SPEAKER_1', CAST(idx % 3 AS STRING)) AS speaker FROM seg)"
)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, idx, seg_id, speaker, text, start_s, end_s, event_id, avg_logprob, no_speech_prob, compression_ratio)."""
    # the braces in the texts must not be read as parameters of spark.sql
    table(spark, sf_dir, "events").createOrReplaceTempView("meetspark_events")
    return spark.sql(SEGMENTS.replace("EVENTS_TABLE", "meetspark_events"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns: the segments shifted in time, with other speakers."""
    return segments(spark, sf_dir).selectExpr("meeting_id", "idx", "start_s - 1.5 AS s", "end_s - 3.0 AS e", "concat('SPEAKER_1', CAST(idx % 3 AS STRING)) AS speaker")

"""A corpus of meetings with general and specific queries, one nested JSON file each, as three tables and an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meetspark.functions.text import clean_text, meeting_domain
from meetspark.operators.corpora import span_turns

_QUERY = "struct<query:string,answer:string>"
SCHEMA = (
    "meeting_transcripts array<struct<speaker:string,content:string>>, general_query_list string, "
    "specific_query_list array<struct<query:string,answer:string,relevant_text_span:array<array<string>>>>, "
    "topic_list array<struct<topic:string,relevant_text_span:array<array<string>>>>"
)


def read_meetings(spark: SparkSession, folder: str) -> DataFrame:
    """(meeting_id, split, domain, turns, general, specific, topics) of the files ``folder``/{train,val,test}/*.json.

    The list of general queries may be a list, a single one or missing. A file
    that is no JSON gives a meeting without turns.
    """
    raw = spark.read.option("multiLine", True).schema(SCHEMA).json([f"{folder}/{s}" for s in ("train", "val", "test")])
    path = F.col("_metadata.file_path")
    split = F.regexp_extract(path, r"/(train|val|test)/[^/]+$", 1)
    given = raw.select(F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("meeting_id"), F.when(split == "val", "validation").otherwise(split).alias("split"), "*")
    listed = F.from_json("general_query_list", f"array<{_QUERY}>")
    one = F.from_json("general_query_list", _QUERY)
    general = F.when(F.ltrim("general_query_list").startswith("["), F.get(listed, F.lit(0))).otherwise(one)
    empty = lambda c: F.coalesce(c, F.from_json(F.lit("[]"), raw.schema[c].dataType))
    return given.select(
        "meeting_id", "split", meeting_domain(F.col("meeting_id")).alias("domain"), empty("meeting_transcripts").alias("turns"), general.alias("general"),
        empty("specific_query_list").alias("specific"), empty("topic_list").alias("topics"),
    )


def _line(turn: Column) -> Column:
    return F.concat(F.coalesce(clean_text(turn["speaker"]), F.lit("")), F.lit(": "), clean_text(turn["content"]))


def general_meetings(meetings: DataFrame) -> DataFrame:
    """(meeting_id, split, domain, turn_count, transcript, query, answer) of every meeting."""
    return meetings.select(
        "meeting_id", "split", "domain", F.size("turns").alias("turn_count"), F.array_join(F.transform("turns", _line), "\n").alias("transcript"),
        F.coalesce("general.query", F.lit("Summarize the meeting.")).alias("query"), F.coalesce("general.answer", F.lit("")).alias("answer"),
    )


def _with_spans(meetings: DataFrame, items: str, kind: str, columns: list[str]) -> DataFrame:
    each = meetings.select("meeting_id", "split", "domain", F.posexplode(items).alias("n", "q"))
    each = each.select("meeting_id", "split", "domain", F.concat("meeting_id", F.lit(f".{kind}"), "n").alias("example_id"), *[F.coalesce(f"q.{c}", F.lit("")).alias(c) for c in columns], F.col("q.relevant_text_span").alias("relevant_text_span"))
    turns = meetings.select("meeting_id", F.posexplode("turns").alias("idx", "turn")).select("meeting_id", "idx", _line(F.col("turn")).alias("line"))
    chosen = span_turns(each, turns).join(each.select("example_id", "meeting_id"), "example_id").join(turns, ["meeting_id", "idx"])
    lines = F.array_sort(F.collect_list(F.struct("range_no", "idx", "line")))
    texts = chosen.groupBy("example_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("relevant_transcript"))
    return each.join(texts, "example_id", "left").withColumn("relevant_transcript", F.coalesce("relevant_transcript", F.lit("")))


def specific_queries(meetings: DataFrame) -> DataFrame:
    """One row per specific query, with the turns its ranges select."""
    return _with_spans(meetings, "specific", "query", ["query", "answer"])


def topics(meetings: DataFrame) -> DataFrame:
    """One row per topic, with the turns its ranges select."""
    return _with_spans(meetings, "topics", "topic", ["topic"])


def audit(meetings: DataFrame) -> DataFrame:
    """(split, domain, n_meetings, n_queries, n_topics) of the corpus."""
    return meetings.groupBy("split", "domain").agg(F.count("*").alias("n_meetings"), F.sum(F.size("specific")).alias("n_queries"), F.sum(F.size("topics")).alias("n_topics"))

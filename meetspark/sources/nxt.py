"""Corpus files: NXT word and segment XML, JSON lines, RTTM."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

NITE = "{http://nite.sourceforge.net/}id"
#: Longest utterance in seconds, and signs that are written without a space. Fixed values.
MAX_SECONDS = 28.0
NO_SPACE_BEFORE, NO_SPACE_AFTER = set(".,?!:;)]}%'\""), set("([{")
_RANGE = re.compile(r"id\(([^)]+)\)(?:\.\.id\(([^)]+)\))?")
WORD_SCHEMA = "path string, pos int, token_id string, kind string, text string, start_s double, end_s double, punctuation boolean"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def read_words(files: DataFrame) -> DataFrame:
    """Tokens of whole word files (path, value) in document order; elements without id are skipped.

    Sounds keep their place and id but have no text. Missing times are 0.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, value in zip(batch["path"], batch["value"]):
                tagged = [e for e in ET.fromstring(value) if e.get(NITE)]
                for pos, e in enumerate(tagged):
                    word = _local(e.tag) == "w"
                    rows.append((path, pos, e.get(NITE), _local(e.tag), " ".join((e.text or "").split()) if word else "", float(e.get("starttime", 0)), float(e.get("endtime", 0)), e.get("punc", "").lower() == "true"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WORD_SCHEMA.split(", ")])

    return files.select("path", "value").mapInPandas(parse, WORD_SCHEMA)


def read_segment_refs(files: DataFrame) -> DataFrame:
    """(path, segment_id, seg_pos, ref_pos, first_id, last_id, start_s, end_s): the word ranges of each segment."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, value in zip(batch["path"], batch["value"]):
                for n, e in enumerate(x for x in ET.fromstring(value) if _local(x.tag) == "segment"):
                    bound = [float(e.get(k)) if e.get(k) else None for k in ("transcriber_start", "transcriber_end")]
                    for k, child in enumerate(c for c in e if _local(c.tag) == "child"):
                        hit = _RANGE.search(child.get("href", ""))
                        if hit:
                            rows.append((path, e.get(NITE), n, k, hit[1], hit[2] or hit[1], *bound))
            yield pd.DataFrame(rows, columns=["path", "segment_id", "seg_pos", "ref_pos", "first_id", "last_id", "start_s", "end_s"])

    return files.select("path", "value").mapInPandas(parse, "path string, segment_id string, seg_pos int, ref_pos int, first_id string, last_id string, start_s double, end_s double")


def tokens_in_ranges(refs: DataFrame, words: DataFrame) -> DataFrame:
    """Each reference with its tokens: an inclusive range over document order, swapped if reversed.

    ``refs`` needs speaker_key, ``words`` too. Ranges with an unknown end are empty.
    """
    places = words.select("speaker_key", F.col("token_id"), F.col("pos"))
    first = places.select("speaker_key", F.col("token_id").alias("first_id"), F.col("pos").alias("p"))
    last = places.select("speaker_key", F.col("token_id").alias("last_id"), F.col("pos").alias("q"))
    spans = refs.join(first, ["speaker_key", "first_id"]).join(last, ["speaker_key", "last_id"])
    each = spans.withColumn("pos", F.explode(F.sequence(F.least("p", "q"), F.greatest("p", "q")))).drop("p", "q", "first_id", "last_id")
    tokens = words.select("speaker_key", "pos", "token_id", "kind", "text", F.col("start_s").alias("token_start"), F.col("end_s").alias("token_end"), "punctuation")
    return each.join(tokens, ["speaker_key", "pos"])


def join_tokens(tokens: list[dict]) -> str:
    """Tokens as text: no space before punctuation or behind an opening bracket."""
    out = ""
    for t in tokens:
        text = " ".join((t["text"] or "").split())
        if text:
            tight = not out or t["punctuation"] or text in NO_SPACE_BEFORE or out[-1] in NO_SPACE_AFTER
            out += text if tight else " " + text
    return out


def utterances(tokens: DataFrame, limit: float = MAX_SECONDS) -> DataFrame:
    """(speaker_key, segment_id, start_s, end_s, text): segments without words dropped, long ones cut before the word that exceeds ``limit``.

    Parts of a cut segment are named ``.part1`` and so on and take the times of their words.
    """
    row = F.struct("ref_pos", "pos", "text", "token_start", "token_end", "punctuation")
    groups = tokens.groupBy("speaker_key", "segment_id", "start_s", "end_s").agg(F.array_sort(F.collect_list(row)).alias("tokens"))
    lexical = lambda ts: [t for t in ts if t["text"] and not t["punctuation"]]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g in batch.itertuples():
                words = lexical(g.tokens)
                if not words:
                    continue
                parts, begun = [[]], words[0]["token_start"]
                for t in g.tokens:
                    if t["text"] and parts[-1] and t["token_end"] - begun > limit:
                        parts.append([])
                        begun = t["token_start"]
                    parts[-1].append(t)
                parts = [p for p in parts if lexical(p)]
                low = words[0]["token_start"] if pd.isna(g.start_s) else g.start_s
                high = words[-1]["token_end"] if pd.isna(g.end_s) else g.end_s
                for n, p in enumerate(parts, 1):
                    own = lexical(p)
                    whole = len(parts) == 1 and high - low <= limit
                    name = g.segment_id if len(parts) == 1 else f"{g.segment_id}.part{n}"
                    out.append((g.speaker_key, name, low if whole else own[0]["token_start"], high if whole else own[-1]["token_end"], join_tokens(p)))
            yield pd.DataFrame(out, columns=["speaker_key", "segment_id", "start_s", "end_s", "text"])

    return groups.mapInPandas(cut, "speaker_key string, segment_id string, start_s double, end_s double, text string")


def read_sections(files: DataFrame) -> DataFrame:
    """(path, section, pos, sentence) of abstractive summaries: abstract, actions, decisions, problems."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, value in zip(batch["path"], batch["value"]):
                for section in ET.fromstring(value):
                    said = [" ".join((s.text or "").split()) for s in section if _local(s.tag) == "sentence"]
                    rows += [(path, _local(section.tag), n, s) for n, s in enumerate(x for x in said if x)]
            yield pd.DataFrame(rows, columns=["path", "section", "pos", "sentence"])

    return files.select("path", "value").mapInPandas(parse, "path string, section string, pos int, sentence string")


def read_meetings(files: DataFrame) -> DataFrame:
    """(meeting_id, split, duration_s, agent, role, speaker_id) from meetings files; scenario meetings ES0000a to d only."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch["value"]:
                for m in (e for e in ET.fromstring(value) if _local(e.tag) == "meeting"):
                    if re.fullmatch(r"ES\d{4}[a-d]", m.get("observation", "")):
                        split = {"training": "train", "development": "validation"}.get(m.get("seen_type", ""), "test")
                        rows += [(m.get("observation"), split, float(m.get("duration") or 0), s.get("nxt_agent"), s.get("role"), s.get("global_name")) for s in m if _local(s.tag) == "speaker"]
            yield pd.DataFrame(rows, columns=["meeting_id", "split", "duration_s", "agent", "role", "speaker_id"])

    return files.select("value").mapInPandas(parse, "meeting_id string, split string, duration_s double, agent string, role string, speaker_id string")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """(meeting_id, start, duration, speaker) of SPEAKER lines."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.col("value").startswith("SPEAKER "))
    return lines.select(F.get(parts, F.lit(1)).alias("meeting_id"), F.get(parts, F.lit(3)).try_cast("double").alias("start"), F.get(parts, F.lit(4)).try_cast("double").alias("duration"), F.get(parts, F.lit(7)).alias("speaker"))

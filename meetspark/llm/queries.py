"""Registered queries of the llm subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from meetspark.llm import crosssplit, defects, encoding, leak, lookalike, nearest, splitting, turns
from meetspark.runtime import table

QUERIES = {
    "p1_found": lambda s, d: splitting.p1_found(table(s, d, "general_meetings"), table(s, d, "chunk_limits")),
    "p1_pieces": lambda s, d: splitting.p1_pieces(table(s, d, "general_meetings"), table(s, d, "chunk_limits")),
    "p3_found": lambda s, d: crosssplit.p3_found(table(s, d, "general_meetings"), table(s, d, "speaker_roster")),
    "p3_counts": lambda s, d: crosssplit.p3_counts(table(s, d, "general_meetings"), table(s, d, "speaker_roster")),
    "p4_found": lambda s, d: defects.p4_found(table(s, d, "specific_queries"), table(s, d, "predictions")),
    "p5_found": lambda s, d: nearest.p5_found(table(s, d, "speaker_segments"), table(s, d, "diarization")),
    "p6_found": lambda s, d: turns.p6_found(table(s, d, "general_meetings"), table(s, d, "specific_queries"), table(s, d, "speaker_roster")),
    "p6_turns": lambda s, d: turns.p6_turns(table(s, d, "general_meetings"), table(s, d, "specific_queries"), table(s, d, "speaker_roster")),
    "p7_ids": lambda s, d: encoding.p7_ids(table(s, d, "documents")),
    "p7_roundtrip": lambda s, d: encoding.p7_roundtrip(table(s, d, "documents")),
    "p8_found": lambda s, d: leak.p8_found(table(s, d, "documents"), table(s, d, "eval_passages")),
    "p8_leaked": lambda s, d: leak.p8_leaked(table(s, d, "documents"), table(s, d, "eval_passages")),
    "p9_found": lambda s, d: lookalike.p9_found(table(s, d, "documents")),
    "p9_canonical": lambda s, d: lookalike.p9_canonical(table(s, d, "documents")),
}

ORACLES = {
    "p1_found": r"""
WITH l AS (
  SELECT g.record_id, g.transcript AS t, coalesce(c.max_chars, (SELECT max_chars FROM chunk_limits WHERE domain = 'default')) AS m
  FROM general_meetings g LEFT JOIN chunk_limits c ON g.domain = c.domain),
o AS (SELECT * FROM l WHERE length(t) > m)
SELECT DISTINCT record_id, CASE
  WHEN list_max(list_transform(string_split(t, chr(10)), lambda x: length(x))) <= m THEN 'line'
  WHEN list_max(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: length(x))) <= m THEN 'sentence'
  WHEN list_max(list_transform(regexp_split_to_array(t, '\s+'), lambda x: length(x))) <= m THEN 'word'
  ELSE 'char' END AS boundary
FROM o""",
    "p5_found": """
WITH s AS (SELECT DISTINCT segment_id, meeting_id, CAST(round(timestamp[1] * 1000) AS BIGINT) AS l FROM speaker_segments),
t AS (SELECT DISTINCT meeting_id, CAST(round(x.turn.start * 1000) AS BIGINT) AS r
      FROM (SELECT meeting_id, unnest(exclusive_turns) AS turn FROM diarization) x)
SELECT DISTINCT segment_id, arg_min(r, struct_pack(d := abs(r - l), r := r)) AS turn_start_ms
FROM s JOIN t USING (meeting_id) WHERE abs(r - l) <= 1500 GROUP BY segment_id, s.meeting_id, l""",
}

"""Registered queries of the core for the problems tagged general, with SQL."""

from __future__ import annotations

from meetspark.operators import intervals
from meetspark.runtime import table

_COVERED = r"""
WITH r AS (
  SELECT meeting_id,
         coalesce(nullif(upper(regexp_replace(speaker_id, '^\s+|\s+$', '', 'g')), ''), agent, 'unknown') AS speaker_id,
         CASE WHEN NOT isnan(start) THEN CAST(round(start * 1000) AS BIGINT) END AS s,
         CASE WHEN NOT isnan(duration) THEN CAST(round(duration * 1000) AS BIGINT) END AS d
  FROM asr_segments),
i AS (SELECT meeting_id, speaker_id, s, s + d AS e FROM r WHERE s IS NOT NULL AND d > 0),
m AS (SELECT *, max(e) OVER (PARTITION BY meeting_id, speaker_id ORDER BY s, e
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)
"""

QUERIES = {
    "p2_found": lambda spark, d: intervals.p2_found(table(spark, d, "asr_segments")),
    "p2_periods": lambda spark, d: intervals.p2_periods(table(spark, d, "asr_segments")),
}

ORACLES = {
    "p2_found": _COVERED
    + "SELECT DISTINCT meeting_id, speaker_id, before AS gap_start_ms, s AS gap_end_ms FROM m WHERE s > before",
    "p2_periods": _COVERED
    + """, f AS (SELECT *, CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END AS opens FROM m),
g AS (SELECT *, sum(opens) OVER (PARTITION BY meeting_id, speaker_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT meeting_id, speaker_id, min(s) AS period_start_ms, max(e) AS period_end_ms FROM g GROUP BY meeting_id, speaker_id, k""",
}

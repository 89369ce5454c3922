"""Cutting oversized texts at natural boundaries by recursive bisection (problem 1)."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LEVELS = ("line", "sentence", "word", "char")
#: Code points with the Unicode property White_Space.
WHITE = np.array([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
_STOPS = np.array([ord(c) for c in ".!?"], dtype=np.uint32)
#: Code points that belong to the character before them.
_JOINED = [(0x300, 0x36F), (0x200D, 0x200D), (0xFE00, 0xFE0F), (0x1F3FB, 0x1F3FF), (0x20D0, 0x20FF)]

PIECES = "array<struct<start:int,core_start:int,end:int,level:string>>"


class Boundaries:
    """Places where a text may be cut, by strength, and its longest unit at each level."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.points, n = points, len(points)
        white = np.isin(points, WHITE)
        lines = np.flatnonzero(points == 10)
        visible = np.append(np.flatnonzero(~white), n)
        stops = np.flatnonzero(np.isin(points[:-1], _STOPS) & white[1:]) + 1 if n else np.array([], dtype=int)
        resume = visible[np.searchsorted(visible, stops)] if n else stops
        words = np.flatnonzero(white[:-1] & ~white[1:]) + 1 if n else stops
        self.longest = {"line": self._longest(n, lines, lines + 1), "word": self._longest(n, w := np.flatnonzero(white), w + 1), "char": 1}
        ends, starts = np.concatenate([lines, stops]), np.concatenate([lines + 1, resume])
        order = np.argsort(ends, kind="stable")
        self.longest["sentence"] = self._longest(n, ends[order], starts[order])
        self.cuts = [np.unique(x[(x > 0) & (x < n)]).tolist() for x in (lines + 1, resume, words)]

    @staticmethod
    def _longest(n: int, ends: np.ndarray, starts: np.ndarray) -> int:
        return int((np.append(ends, n) - np.append(0, starts)).max(initial=0))

    def level(self, limit: int) -> str:
        """The coarsest level at which every unit has at most ``limit`` characters."""
        return next(x for x in LEVELS if self.longest[x] <= limit or x == "char")

    def near(self, cuts: list[int], middle: int, low: int, high: int) -> int | None:
        """The cut nearest to ``middle`` that lies in [low, high]."""
        i = bisect_left(cuts, middle)
        found = [c for c in cuts[max(0, i - 1) : i + 1] if low <= c <= high]
        return min(found, key=lambda c: (abs(c - middle), c), default=None)

    def whole(self, at: int, low: int) -> int:
        """``at``, or the nearest earlier place above ``low`` that doesn't tear a character from its marks."""
        return next((place for place in range(at, low, -1) if not self.belongs(place)), at)

    def belongs(self, at: int) -> bool:
        """Whether the character at ``at`` belongs to the one before it."""
        return at > 0 and (any(a <= self.points[at] <= b for a, b in _JOINED) or bool(self.points[at - 1] == 0x200D))


def bisect_text(text: str, limit: int, overlap: int) -> tuple[str, list[tuple[int, int, int, str]]]:
    """The boundary level of ``text`` and its pieces (start, core_start, end, level).

    The cores follow one another without gap or overlap; [start, core_start) is
    shared with the piece before; every piece has at most ``limit`` characters.
    level is the strength of the cut at core_start ('' for the first piece).
    Any overlap below the limit is honoured; one that isn't leaves no room for
    anything new and is refused.
    """
    limit, overlap = max(1, limit), max(0, overlap)
    if overlap >= limit:
        raise ValueError(f"an overlap of {overlap} characters doesn't fit a limit of {limit}")
    found = Boundaries(text)
    n, room = len(found.points), limit - overlap
    cores: list[tuple[int, int, str]] = []
    stack = [(0, n, "")]
    while stack:
        low, high, level = stack.pop()
        if high - low <= (limit if n <= limit else room):
            cores.append((low, high, level))
            continue
        middle, quarter = (low + high) // 2, max(1, (high - low) // 4)
        cut = None
        for margin in (quarter, 1):  # near the middle first, else wherever there is a natural boundary
            for name, cuts in zip(LEVELS, found.cuts):
                cut = found.near(cuts, middle, low + margin, high - margin)
                if cut is not None:
                    break
            if cut is not None:
                break
        if cut is None:
            cut, name = found.whole(middle, low + 1), "char"
        stack += [(cut, high, name), (low, cut, level)]
    pieces, before = [], 0
    for low, high, level in cores:
        start = low
        if pieces and overlap:
            first = max(before, low - overlap)
            words = found.cuts[2]
            i = bisect_left(words, first)
            start = first if first == before else words[i] if i < len(words) and words[i] < low else first
            while start < low and found.belongs(start):
                start += 1
        pieces.append((start, low, high, level))
        before = low
    return found.level(limit), pieces


def _split(texts: pd.Series, limits: pd.Series, overlaps: pd.Series) -> pd.DataFrame:
    rows = [bisect_text(t, int(m), int(o)) for t, m, o in zip(texts, limits, overlaps)]
    pieces = [[dict(zip(("start", "core_start", "end", "level"), p)) for p in ps] for _, ps in rows]
    return pd.DataFrame({"boundary": [b for b, _ in rows], "pieces": pieces})


def with_limits(records: DataFrame, limits: DataFrame) -> DataFrame:
    """Add max_chars and overlap_chars of the record's domain.

    A domain that is null or has no row of its own takes the row ``default``;
    without such a row the record is left out. Of repeated limits the smallest
    counts.
    """
    own = limits.groupBy(F.col("domain").alias("__domain")).agg(F.min("max_chars").alias("__max"), F.min("overlap_chars").alias("__overlap"))
    rest = own.where(F.col("__domain") == "default").select(
        F.col("__domain").alias("__default"), F.col("__max").alias("__dmax"), F.col("__overlap").alias("__doverlap")
    )
    kept = records.drop("max_chars", "overlap_chars")
    joined = kept.join(own, kept["domain"] == own["__domain"], "left")
    joined = joined.withColumn("__key", F.when(F.col("__max").isNull(), F.lit("default")).otherwise(F.col("__domain")))
    joined = joined.join(rest, F.when(F.col("__max").isNull(), F.col("__key")) == rest["__default"], "left")
    return (
        joined.withColumn("max_chars", F.coalesce("__max", "__dmax"))
        .withColumn("overlap_chars", F.coalesce("__overlap", "__doverlap", F.lit(0)))
        .where(F.col("max_chars").isNotNull())
        .drop("__domain", "__max", "__overlap", "__default", "__dmax", "__doverlap", "__key")
    )


def oversized(records: DataFrame, limits: DataFrame, text: str, key: str) -> DataFrame:
    """(key, text, max_chars, overlap_chars) of each record whose text exceeds its limit; lengths are compared in the JVM."""
    return with_limits(records.select(key, "domain", text), limits).where(F.length(text) > F.col("max_chars"))


def cut(sized: DataFrame, text: str, key: str) -> DataFrame:
    """(key, text, max_chars, boundary, pieces) of oversized texts: bisected, overlaps attached afterwards."""
    parts = F.pandas_udf(_split, f"struct<boundary:string,pieces:{PIECES}>")(F.col(text), F.col("max_chars"), F.col("overlap_chars"))
    return sized.withColumn("__parts", parts).select(key, text, "max_chars", F.col("__parts.boundary").alias("boundary"), F.col("__parts.pieces").alias("pieces"))


def split_oversized(records: DataFrame, limits: DataFrame, text: str, key: str) -> DataFrame:
    """(key, text, max_chars, boundary, pieces) of each record whose text exceeds its limit.

    Lengths are compared in the JVM, so only oversized texts reach Python. Null
    and empty texts are never oversized.
    """
    return cut(oversized(records, limits, text, key), text, key)


def p1_found(meetings: DataFrame, limits: DataFrame) -> DataFrame:
    """(record_id, boundary) of each oversized transcript, cut as for p1_pieces.

    An overlap that isn't below the limit has no bearing on the boundary and is
    taken as none here.
    """
    fits = F.when(F.col("overlap_chars") < F.col("max_chars"), F.col("overlap_chars")).otherwise(0)
    sized = oversized(meetings, limits, "transcript", "record_id").withColumn("overlap_chars", fits)
    return cut(sized, "transcript", "record_id").select("record_id", "boundary").distinct()


def p1_pieces(meetings: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per piece of an oversized transcript, in order, with its text.

    Positions count characters from 0; end_char is exclusive; the first
    overlap_chars characters are those shared with the piece before.
    """
    found = split_oversized(meetings, limits, "transcript", "record_id")
    pieces = found.select("record_id", "transcript", F.posexplode("pieces").alias("at", "p"))
    start: Column = F.col("p.start")
    return pieces.select(
        "record_id",
        (F.col("at") + 1).alias("piece_no"),
        start.alias("start_char"),
        F.col("p.end").alias("end_char"),
        (F.col("p.core_start") - start).alias("overlap_chars"),
        F.col("p.level").alias("level"),
        F.substring("transcript", start + 1, F.col("p.end") - start).alias("text"),
    )

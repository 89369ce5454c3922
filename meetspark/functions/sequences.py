"""Common subsequences and edit distances of word sequences, bit-parallel, in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F


def _places(words: Sequence[str]) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, w in enumerate(words):
        found[w] = found.get(w, 0) | 1 << i
    return found


def common_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence: a row of the usual table is one whole number."""
    places, full = _places(a), (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def edit_distance(a: list[str], b: list[str]) -> int:
    """Least number of inserted, deleted and changed words: a column of differences is two whole numbers."""
    if not a:
        return len(b)
    places, full, top = _places(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, total = full, 0, len(a)
    for w in b:
        same = places.get(w, 0)
        level = same | down
        moved = ((same & up) + up ^ up) | same
        more, less = (down | ~(moved | up)) & full, up & moved
        total += (more & top > 0) - (less & top > 0)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = (less | ~(level | more)) & full, more & level
    return total


def _column(measure):
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([measure(list(a), list(b)) if a is not None and b is not None else None for a, b in zip(left, right)], dtype="Int64")

    return lambda a, b: F.pandas_udf(of, "int")(a, b)


def common_subsequence(left: Column, right: Column) -> Column:
    return _column(common_length)(left, right)


def word_edits(left: Column, right: Column) -> Column:
    return _column(edit_distance)(left, right)

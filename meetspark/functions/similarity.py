"""Fuzzy text similarity: token overlap in Python sets, sequence ratio by difflib, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from meetspark.functions.sequences import common_length

_TOKEN = re.compile(r"[\w']+")
_ODD = re.compile(r"[^\w\s]")


def _clean(text: object) -> str:
    return "" if text is None or text != text else " ".join(str(text).split())


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _share(a: set[str], b: set[str], of: int) -> float:
    return len(a & b) / max(1, of)


def evidence_ratio(left: object, right: object) -> float:
    """Length ratio if one text holds the other, else the larger of token Jaccard and sequence ratio; 0 for empty texts."""
    a, b = _clean(left).casefold(), _clean(right).casefold()
    if not (a and b):
        return 0.0
    short, long = sorted((a, b), key=len)
    if short in long:
        return len(short) / len(long)
    x, y = set(_TOKEN.findall(a)), set(_TOKEN.findall(b))
    return max(_share(x, y, len(x | y)), _ratio(a, b))


def evidence_bounds(left: list, right: list) -> Callable[[int], np.ndarray]:
    """Of a left item, bounds of evidence_ratio with every right one: what letters and tokens they share, in any order.

    As whole numbers are divided as in the ratio itself, no bound lies below it.
    """
    clean = [[_clean(t).casefold() for t in texts] for texts in (left, right)]
    letters = {c: k for k, c in enumerate(sorted(set().union(*map(set, clean[0] + clean[1]))))}

    def counted(text: str) -> np.ndarray:
        return np.bincount(np.array([letters[c] for c in text], dtype=np.int64), minlength=len(letters))

    a, b = (np.array([counted(t) for t in texts], dtype=np.int32).reshape(len(texts), len(letters)) for texts in clean)
    x, y = ([set(_TOKEN.findall(t)) for t in texts] for texts in clean)
    size = b.sum(1)
    holders: dict[str, list[int]] = {}
    for k, h in enumerate(y):
        for w in h:
            holders.setdefault(w, []).append(k)
    n = np.array([len(h) for h in y], dtype=np.int64)

    def bounds(i: int) -> np.ndarray:
        shared = np.zeros(len(b), dtype=np.int64)
        for w in x[i]:
            shared[holders.get(w, [])] += 1
        letter = 2.0 * np.minimum(a[i], b).sum(1) / np.maximum(1, a[i].sum() + size)
        return np.maximum(letter, shared / np.maximum(1, len(x[i]) + n - shared))

    return bounds


def within_reach(left: object, right: object, least: float) -> bool:
    """Whether evidence_ratio may reach ``least``: a sequence ratio counts letters of a common subsequence, the longest of which is found much faster."""
    a, b = _clean(left).casefold(), _clean(right).casefold()
    if 2.0 * common_length(a, b) >= least * (len(a) + len(b)) - 1e-9:
        return True
    x, y = set(_TOKEN.findall(a)), set(_TOKEN.findall(b))
    return _share(x, y, len(x | y)) >= least


def metric_ratio(left: object, right: object) -> float:
    """1 for texts equal without case and punctuation, else the larger of token Jaccard and sequence ratio."""
    a, b = (" ".join(_ODD.sub(" ", str(t).lower()).split()) for t in (left, right))
    if not (a and b):
        return 0.0
    x, y = set(a.split()), set(b.split())
    return 1.0 if a == b else max(_share(x, y, len(x | y)), _ratio(a, b))


def segment_ratio(left: object, right: object) -> float:
    """The larger of token containment and sequence ratio of two segments' words."""
    a, b = (" ".join(_TOKEN.findall(_clean(t).casefold())) for t in (left, right))
    if not (a and b):
        return 0.0
    x, y = set(a.split()), set(b.split())
    return max(_share(x, y, min(len(x), len(y))), _ratio(a, b))


def _column(ratio):
    def scores(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype="float64")

    return lambda a, b: F.pandas_udf(scores, "double")(a, b)


def evidence_similarity(left: Column, right: Column) -> Column:
    return _column(evidence_ratio)(left, right)


def metric_similarity(left: Column, right: Column) -> Column:
    return _column(metric_ratio)(left, right)


def segment_similarity(left: Column, right: Column) -> Column:
    return _column(segment_ratio)(left, right)

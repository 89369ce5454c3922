"""JSON objects inside chatty or truncated model output."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F

_PART = re.compile(r'"(?:\\.|[^"\\])*"|"|[{}\[\],]', re.S)
_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.I)
#: Fields of an analysis; a repaired object must have one. Fixed values.
KNOWN = ["meeting_summary", "participants", "topics", "key_points", "requirements", "decisions", "action_items", "risks", "open_questions", "assumptions", "missing_information", "uncertainties"]
#: Places a truncated object may be cut back to, at most.
CUTS = 60


def _object(text: str) -> dict | None:
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _repaired(text: str) -> dict | None:
    """The longest prefix, closed where it breaks off, that is an object with a known field."""
    start = text.find("{")
    if start < 0:
        return None
    ends: list[tuple[int, str]] = []
    stack: list[str] = []
    for m in _PART.finditer(text, start):
        c = m[0]
        if c == '"':  # a string that never ends
            ends.append((m.start(), "".join(reversed(stack))))
            ends.append((len(text), '"' + "".join(reversed(stack))))
            break
        if c == ",":
            ends.append((m.start(), "".join(reversed(stack))))
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            ends.append((m.end(), "".join(reversed(stack))))
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            ends.append((m.end(), "".join(reversed(stack))))
    else:
        ends.append((len(text), "".join(reversed(stack))))
    for at, closing in reversed(ends[-CUTS:]):
        value = _object(text[start:at].rstrip().rstrip(",:") + closing)
        if value is not None and any(k in value for k in KNOWN):
            return value
    return None


def extract(text: str | None) -> str | None:
    """The first JSON object of ``text`` as JSON; None if there is none.

    Text that is JSON as a whole but no object gives None. Truncated objects are
    closed if they hold a known field.
    """
    if text is None or not text.strip():
        return None
    shown = _FENCE.sub("", text.strip())
    try:
        value = json.loads(shown)
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None
    except ValueError:
        pass
    depth, start = 0, 0
    for m in _PART.finditer(shown):
        if m[0] == "{":
            depth, start = depth + 1, m.start() if depth == 0 else start
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0 and (found := _object(shown[start : m.end()])) is not None:
                return json.dumps(found, ensure_ascii=False)
    found = _repaired(shown) if any(f'"{k}"' in shown for k in KNOWN) else None
    return None if found is None else json.dumps(found, ensure_ascii=False)


def extract_json(text: Column) -> Column:
    """``extract`` in Arrow batches, only for text that isn't an object already."""

    def many(values: pd.Series) -> pd.Series:
        return pd.Series([extract(v) for v in values], dtype="object")

    plain = F.trim(text).startswith("{") & F.try_parse_json(text).isNotNull()
    return F.when(plain, F.trim(text)).otherwise(F.pandas_udf(many, "string")(F.when(~plain | plain.isNull(), text)))

"""JSON in model answers: fenced blocks, the outermost brackets, repair of usual faults."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def fenced(text: Column) -> Column:
    """What stands between ```json and the last ```; the trimmed text if there is no fence."""
    body = F.regexp_extract(text, r"```json\s*([\s\S]*)```", 1)
    return F.trim(F.when(F.coalesce(body, F.lit("")) == "", F.replace(text, F.lit("```json"), F.lit(""))).otherwise(body))


def extract_json(text: str | None) -> object:
    """The JSON value in a text; ``{}`` if nothing can be made of it."""
    if not text:
        return {}
    found = _FENCE.search(text)
    body = (found[1] if found else text).strip()
    for attempt in _attempts(body):
        try:
            return json.loads(attempt)
        except ValueError:
            continue
    return {}


def _attempts(body: str):
    yield body
    spots = [i for i in (body.find("{"), body.find("[")) if i >= 0]
    if spots:
        at = min(spots)
        end = body.rfind("}" if body[at] == "{" else "]")
        body = body[at : end + 1] if end > at else body[at:]
        yield body
    body = re.sub(r"\bNone\b", "null", body)
    body = re.sub(r"\bTrue\b", "true", body)
    body = re.sub(r"\bFalse\b", "false", body)
    body = re.sub(r",\s*([}\]])", r"\1", body)
    yield body
    if "'" in body and '"' not in body:
        yield body.replace("'", '"')
    yield " ".join(body.split())
    # brackets that were never closed
    stack, quoted, skip = [], False, False
    for c in body:
        if skip:
            skip = False
        elif c == "\\":
            skip = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            stack.append("}" if c == "{" else "]")
        elif not quoted and c in "}]" and stack:
            stack.pop()
    closed = re.sub(r"[,:]\s*$", "", body + ('"' if quoted else ""))
    yield closed + "".join(reversed(stack))


def repaired_series(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: json.dumps(extract_json(t), ensure_ascii=False))


def repaired(text: Column) -> Column:
    """The value of :func:`extract_json` as JSON text."""
    return F.pandas_udf(repaired_series, "string")(text)

"""JSON objects inside the prose of a model's answer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```(?:json)?(.*?)```", re.DOTALL | re.IGNORECASE)


def json_object(text: str | None) -> str | None:
    """What the first fence holds, else the first balanced one (strings and escapes minded), else the rest from the first brace."""
    if text is None:
        return None
    fenced = _FENCE.search(text)
    if fenced:
        return fenced.group(1).strip()
    first = text.find("{")
    if first < 0:
        return text.strip()
    text = text.rstrip()
    depth, quoted, at = 0, False, first
    while at < len(text):
        ch = text[at]
        if quoted:
            if ch == "\\":
                at += 1
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "{}":
            depth += 1 if ch == "{" else -1
            if not depth:
                return text[first : at + 1]
        at += 1
    return text[first:]


def _recover(texts: pd.Series) -> pd.Series:
    return texts.map(json_object, na_action="ignore")


def recovered_json(c: Column) -> Column:
    """json_object of a column, in Arrow batches."""
    return F.pandas_udf(_recover, T.StringType())(c)

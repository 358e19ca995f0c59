"""Brace scans of any depth, as Arrow-batched functions (a regex cannot count)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from toolcorpus.functions.jsonx import _ABSENT, decoded

_TEXTS = T.ArrayType(T.StringType())
_BRACE = re.compile("[{}]")
# A JSON string, so that braces inside it do not count, or a brace.
_STRING_OR_BRACE = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}]', re.DOTALL)


def top_level_spans(text: str) -> list[tuple[int, int]]:
    """``[from, to)`` of each stretch where the running count of braces leaves zero upwards and returns to it."""
    at = np.fromiter((m.start() for m in _BRACE.finditer(text)), np.int64)
    if not len(at):
        return []
    step = np.array([1 if text[i] == "{" else -1 for i in at])
    count = np.cumsum(step)
    opens = at[(count == 1) & (step == 1)]
    closes = at[(count == 0) & (step == -1)] + 1
    return list(zip(opens.tolist(), closes.tolist(), strict=False))


def tagged_object(text: str, tag: str) -> str | None:
    """The balanced object right after the first ``tag`` that one follows; braces in strings do not count."""
    found = re.search(re.escape(tag) + r"\s*\{", text)
    if not found:
        return None
    begin, depth = found.end() - 1, 0
    for m in _STRING_OR_BRACE.finditer(text, begin):
        if m.group() in "{}":
            depth += 1 if m.group() == "{" else -1
            if depth == 0:
                return text[begin:m.end()]
    return None


def objects_with(texts, *keys: str):
    """Top-level objects of each text that decode as JSON objects with all ``keys``."""
    def fits(text: str) -> bool:
        value = decoded(text)
        return isinstance(value, dict) and all(k in value for k in keys)

    @F.pandas_udf(_TEXTS)
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [o for o in (t[a:b] for a, b in top_level_spans(t)) if fits(o)] for t in rows])

    return run(texts)


def found_objects(contents, find):
    """For an array of texts, what ``find`` returns of each, if it is JSON."""
    @F.pandas_udf(_TEXTS)
    def run(rows: pd.Series) -> pd.Series:
        found = ([find(t) for t in r if t is not None] if r is not None else None for r in rows)
        return pd.Series([None if r is None else [o for o in r if decoded(o) is not _ABSENT] for r in found])

    return run(contents)

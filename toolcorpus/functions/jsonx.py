"""JSON as Python's decoder reads and writes it.

A text is decoded once, in one pass without backtracking, by Arrow-batched
functions: Spark's own reader differs on duplicate keys (Python keeps the last
value at the place of the first), on NaN and on trailing text, and a regular
expression over tokens overflows the stack on long strings. ``json_string`` and
``ascii_escaped``, which only write, stay JVM expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F

_ABSENT = object()


def decoded(text: str | None):
    """The value of a JSON text; ``_ABSENT`` for null, invalid or too deeply nested text."""
    if text is None:
        return _ABSENT
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return _ABSENT


def encoded(value) -> str | None:
    """``json.dumps``; null if the value is nested too deeply to be written."""
    try:
        return json.dumps(value)
    except RecursionError:
        return None


def utf8(text: str) -> str:
    """``text`` with lone surrogates, which no column can hold, as question marks."""
    return text.encode("utf-8", "replace").decode()


def _each(fn: Callable, kind: str, arrow: pa.DataType):
    """An Arrow function that applies ``fn`` to every value of a batch."""
    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([fn(v) for v in values.to_pylist()], arrow)

    return run


def is_json(col: Column) -> Column:
    """True when ``json.loads(col)`` would succeed (false for null)."""
    return _each(lambda t: decoded(t) is not _ABSENT, "boolean", pa.bool_())(col)


def py_json(col: Column) -> Column:
    """``json.dumps(json.loads(col))``: one blank after commas and colons, ASCII only, the last of equal keys; null if invalid."""
    def run(text):
        value = decoded(text)
        return None if value is _ABSENT else encoded(value)

    return _each(run, "string", pa.string())(col)


def py_json_list(texts: Column) -> Column:
    """``json.dumps`` of the list of the decoded texts; a text that is no JSON is left out, a null list stays null."""
    def run(row):
        return None if row is None else encoded([v for v in map(decoded, row) if v is not _ABSENT])

    return _each(run, "string", pa.string())(texts)


def valid_texts(texts: Column) -> Column:
    """The texts of a list that are JSON, in order."""
    keep = lambda row: None if row is None else [t for t in row if decoded(t) is not _ABSENT]
    return _each(keep, "array<string>", pa.list_(pa.string()))(texts)


def names_of(texts: Column) -> Column:
    """``name`` of each JSON object, ``""`` where it is missing; a name that is no string is given as JSON."""
    def name(text):
        value = decoded(text)
        found = value.get("name", "") if isinstance(value, dict) else ""
        return utf8(found) if isinstance(found, str) else encoded(found)

    return _each(lambda row: None if row is None else [name(t) for t in row], "array<string>", pa.list_(pa.string()))(texts)


def json_string(col: Column) -> Column:
    """JSON string literal for a text column (quotes and escapes added)."""
    arr = F.to_json(F.array(col))
    return ascii_escaped(arr.substr(F.lit(2), F.length(arr) - F.lit(2)))


def ascii_escaped(col: Column) -> Column:
    """Non-ASCII characters as ``\\uXXXX`` (UTF-16 units), as ``json.dumps`` writes them."""
    parts = F.transform(
        F.regexp_extract_all(col, F.lit(r"(?s)[\x00-\x7F]+|[^\x00-\x7F]"), 0),
        lambda t: F.when(t.rlike(r"^[\x00-\x7F]"), t).otherwise(
            F.regexp_replace(F.lower(F.hex(F.encode(t, "UTF-16BE"))), "(.{4})", r"\\u$1")))
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.array_join(parts, "")).otherwise(col)

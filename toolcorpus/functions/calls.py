"""Function-call extraction (text -> call), each text scanned in linear time.

A cascade tries its patterns in turn, the first match of each only: on a match
that is not valid JSON it goes on to the *next pattern*, never to the next
match. The fixed patterns match lazily; as regular expressions they look for
their ends again from every start. The scanner finds each start once: if the
text has no end after the first start, no later start has one either.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

from toolcorpus.functions.jsonx import _ABSENT, decoded, encoded, utf8

# --- fixed values (patterns, DOTALL) -------------------------------------------
TAGGED = r"<functioncall>\s*(\{.*?\})"
NAME_ARGS = r'(\{"name":\s*"[^"]+",\s*"arguments":\s*\{.*?\}\s*\})'
FLAT_NAME = r'(\{[^{}]*"name"[^{}]*\})'
WHOLE = "whole-text"
# ------------------------------------------------------------------------------

PROFILES: dict[str, tuple[str, ...]] = {
    "pairs": (TAGGED, NAME_ARGS, FLAT_NAME),
    "metrics": (TAGGED, NAME_ARGS, FLAT_NAME, WHOLE),
    "inference": (NAME_ARGS, FLAT_NAME),
}

_TAG = re.compile(r"<functioncall>\s*+\{")
_HEAD = re.compile(r'\{"name":\s*+"[^"]++",\s*+"arguments":\s*+\{')
_TAIL = re.compile(r"\}\s*+\}")
_FLAT = re.compile(r"\{[^{}]*+\}")


def tagged(text: str) -> str | None:
    """First match of ``TAGGED``: from the brace after the first tag that one follows to the next closing brace."""
    start = _TAG.search(text)
    end = text.find("}", start.end()) if start else -1
    return text[start.end() - 1:end + 1] if end >= 0 else None


def name_args(text: str) -> str | None:
    """First match of ``NAME_ARGS``."""
    start = _HEAD.search(text)
    end = _TAIL.search(text, start.end()) if start else None
    return text[start.start():end.end()] if end else None


def flat_name(text: str) -> str | None:
    """First match of ``FLAT_NAME``: the first pair of braces without braces inside that holds ``"name"``."""
    return next((m.group() for m in _FLAT.finditer(text) if '"name"' in m.group()), None)


FINDERS = {TAGGED: tagged, NAME_ARGS: name_args, FLAT_NAME: flat_name}


def scan(text: str | None, profile: str) -> tuple[str | None, object]:
    """``(matched text, decoded value)`` of the first pattern whose match is JSON; two nulls if there is none."""
    if not text:
        return None, None
    for pattern in PROFILES[profile]:
        if pattern == WHOLE:
            found = text.strip()
            value = decoded(found) if found[:1] == "{" else _ABSENT
            if isinstance(value, dict) and "name" in value:
                return found, value
            continue
        found = FINDERS[pattern](text)
        value = decoded(found)
        if value is not _ABSENT:
            return found, value
    return None, None


def _texts(fn, *columns: Column) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else fn(v) for v in values.to_pylist()], pa.string())

    return run(*columns)


def first_match(text: Column, pattern: str) -> Column:
    """Group 1 of the first match of a fixed pattern, null when it does not match."""
    return _texts(FINDERS[pattern], text)


def extract_call_text(text: Column) -> Column:
    """Tagged call, else name/arguments object; raw text, *not* validated."""
    def run(t):
        found = tagged(t)
        return name_args(t) if found is None else found

    return _texts(run, text)


def parse_call(text: Column, profile: str = "metrics") -> Column:
    """First pattern of ``profile`` whose match decodes as JSON -> that JSON text, else null."""
    return _texts(lambda t: scan(t, profile)[0], text)


def value_tokens(arguments) -> list[str]:
    """``str(v).lower().split()`` over argument values, keys ignored; none unless the arguments are an object."""
    if not isinstance(arguments, dict):
        return []
    return [utf8(t) for v in arguments.values() for t in str(v).lower().split()]


CALL_TYPE = ("struct<call:string,name:string,name_json:string,has_name:boolean,arguments:string,tokens:array<string>>")
_CALL_ARROW = pa.struct([("call", pa.string()), ("name", pa.string()), ("name_json", pa.string()), ("has_name", pa.bool_()),
                         ("arguments", pa.string()), ("tokens", pa.list_(pa.string()))])


def call_fields(found: str | None, value) -> dict:
    """What the consumers of a call need of it, decoded once."""
    if found is None:
        return {"call": None, "name": None, "name_json": None, "has_name": False, "arguments": None, "tokens": []}
    name, arguments = value.get("name", ""), value.get("arguments", {})
    return {"call": found, "name": utf8(name) if isinstance(name, str) else None, "name_json": encoded(name),
            "has_name": "name" in value, "arguments": encoded(arguments), "tokens": value_tokens(arguments)}


def parsed_call(text: Column, profile: str = "metrics") -> Column:
    """The call of a text as a struct, from one scan: ``call`` (null if there is none), ``name`` (``""`` if missing,
    null if no string), ``name_json``, ``has_name``, ``arguments`` as ``json.dumps`` writes them (``{}`` if missing),
    and ``tokens`` of the argument values."""
    @F.arrow_udf(CALL_TYPE)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([call_fields(*scan(t, profile)) for t in values.to_pylist()], _CALL_ARROW)

    return run(text)

"""Column-level building blocks (all JVM-side except ``lcs``'s Arrow path)."""

from toolcorpus.functions.text import py_split, py_strip, remove_suffix
from toolcorpus.functions.rand import stable_hash
from toolcorpus.functions.rows import keep_where
from toolcorpus.functions.jsonx import (
    is_json, json_string, py_json,
)

__all__ = [
    "keep_where", "py_split", "py_strip", "remove_suffix", "stable_hash",
    "is_json", "json_string", "py_json",
]

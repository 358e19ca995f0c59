"""String helpers with Python ``str`` semantics, expressed as Spark Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Python's str.isspace() set: Unicode White_Space plus the ASCII separators 0x1c-0x1f.
_WS = r"[\s\x{1c}-\x{1f}]"


def py_strip(col: Column) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends (``trim`` only removes blanks)."""
    # Possessive, and only from where a run of blanks begins, so blanks inside a long text are passed once.
    return F.regexp_replace(col, rf"(?U)^{_WS}++|(?<!{_WS}){_WS}++\z", "")


def remove_suffix(col: Column, suffix: str) -> Column:
    """``str.removesuffix(suffix)``."""
    n = len(suffix)
    return F.when(col.endswith(suffix), col.substr(F.lit(1), F.length(col) - F.lit(n))).otherwise(col)


def py_split(col: Column) -> Column:
    """``str.split()`` with no separator: runs of whitespace, no empty tokens."""
    return F.filter(F.split(col, rf"(?U){_WS}+"), lambda t: t != F.lit(""))

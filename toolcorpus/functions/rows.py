"""Row filters over computed columns that the optimizer cannot re-inline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def keep_where(df: DataFrame, cond: Column, *columns: str) -> DataFrame:
    """Rows of ``df`` where ``cond`` holds, with ``cond`` evaluated once per row.

    A plain ``where`` on a column derived from an expensive expression is
    pushed below the projection that computed it, with the expression
    substituted into the filter (so a parse runs twice, or many times when
    several derived columns are chained). Generating from a 0/1-element
    array is a Generate node: it sees the already-computed columns and is not
    rewritten by predicate pushdown.
    """
    cols = list(columns) or df.columns
    row = F.struct(*[F.col(c) for c in cols])
    kept = F.filter(F.array(row), lambda _r: F.coalesce(cond, F.lit(False)))
    return df.select(F.inline(kept))

"""Longest common subsequence of two token arrays.

Two interchangeable implementations:

* ``lcs_length`` - Arrow-batched pandas UDF running the bit-parallel LCS
  recurrence (one big-integer add/or per token of ``a``), O(|a|·|b|/64) per
  row; the default, safe for whole documents.
* ``lcs_length_expr`` - pure Spark higher-order functions (two-row DP as fold
  state), JVM-side but O(|a|·|b|²) because arrays are copied on append; only
  for short arrays.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def lcs_bits(a, b) -> int:
    if a is None or b is None:
        return 0
    n = len(b)
    if n == 0 or len(a) == 0:
        return 0
    masks: dict = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << n) - 1
    v = full
    for tok in a:
        m = masks.get(tok)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_bits(x, y) for x, y in zip(a, b)], dtype="int32")


def rouge_l_py(prediction: str | None, reference: str | None) -> float:
    """Sentence ROUGE-L F1 on ``lower().split()`` tokens (Python's own tokenizer)."""
    a = (prediction or "").lower().split()
    b = (reference or "").lower().split()
    if not a or not b:
        return 0.0
    lcs = lcs_bits(a, b)
    if lcs == 0:
        return 0.0
    p, r = lcs / len(a), lcs / len(b)
    return 2 * p * r / (p + r)


@F.pandas_udf(T.DoubleType())
def rouge_l_text(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """Arrow-batched ROUGE-L over raw strings (strings cross Arrow; tokens never do)."""
    return pd.Series([rouge_l_py(p, r) for p, r in zip(prediction, reference)], dtype="float64")


def lcs_length_expr(a: Column, b: Column) -> Column:
    n = F.size(b)

    def next_row(prev, x):
        def step(cur, j):
            hit = F.element_at(prev, j) + 1
            miss = F.greatest(F.element_at(cur, j), F.element_at(prev, j + 1))
            return F.concat(cur, F.array(F.when(x == F.element_at(b, j), hit).otherwise(miss)))
        return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), step)

    full = F.aggregate(a, F.array_repeat(F.lit(0), n + 1), next_row)
    return F.when((n > 0) & (F.size(a) > 0), F.element_at(full, n + 1)).otherwise(F.lit(0))


def rouge_l_from_tokens(pred: Column, ref: Column, method: str = "arrow") -> Column:
    """Sentence ROUGE-L F1 from token arrays; 0 when either side is empty."""
    lcs = lcs_length(pred, ref) if method == "arrow" else lcs_length_expr(pred, ref)
    lp, lr = F.size(pred), F.size(ref)
    p = F.try_divide(lcs.cast("double"), lp)
    r = F.try_divide(lcs.cast("double"), lr)
    f = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return F.when((lp == 0) | (lr == 0), F.lit(0.0)).otherwise(f)

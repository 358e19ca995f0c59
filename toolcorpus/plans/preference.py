"""Corpus (train split) -> DPO preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from toolcorpus.operators import pairs as E
from toolcorpus.operators import reports as R


def preference_dataset(corpus: DataFrame, seed: int = 42, split: str = "train") -> DataFrame:
    """E1 -> E8: at most one pair per example; one narrow projection, no shuffle."""
    return E.build_pairs(E.pair_examples(corpus.where(F.col("split") == split)), seed)


def pair_report(pairs: DataFrame) -> DataFrame:
    return R.pair_distribution(pairs)

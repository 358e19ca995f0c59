"""Raw dialogues -> parsed, filtered, split corpus -> SFT training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from toolcorpus.operators import parse as B
from toolcorpus.operators import prompts as PR
from toolcorpus.plans.stages import materialize


def build_corpus(raw: DataFrame, ratio: float = 0.05, seed: int = 42, split_mode: str = "exact",
                 call_mode: str = "balanced", max_samples: int | None = None) -> DataFrame:
    """cap (A2) -> parse (B4) -> keep rows with calls (B5) -> split (B6), written once by split."""
    raw = B.head(raw, max_samples)
    corpus = B.parse_corpus(raw, call_mode, calls_only=True)
    corpus = materialize(corpus, "parsed")
    corpus = B.split_corpus(corpus, ratio, seed, split_mode)
    return materialize(corpus, "corpus", partition_by="split")


def sft_dataset(corpus: DataFrame, split: str = "train", mode: str = "pretty") -> DataFrame:
    """C4 over one split (partition-pruned read)."""
    rows = corpus.where(F.col("split") == split)
    return PR.with_system_prompt(rows, mode).select(
        "example_id", PR.render_chatml(PR.to_messages(F.col("system_prompt"), F.col("turns"))).alias("text"))

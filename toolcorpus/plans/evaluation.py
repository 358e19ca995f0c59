"""Evaluation: validation sample -> prompts -> predictions per model -> scores -> reports."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from toolcorpus.operators import parse as B
from toolcorpus.operators import prompts as PR
from toolcorpus.operators import scoring as S
from toolcorpus.plans.stages import materialize


def eval_set(corpus: DataFrame, max_samples: int | None = None, split: str = "validation") -> DataFrame:
    """F1+F2+C5: the rows of the split (the first ``max_samples`` if given) with prompt, reference and allowed names."""
    rows = B.head(corpus.where(F.col("split") == split), max_samples)
    return rows.select("example_id", PR.eval_prompt(F.col("functions"), F.col("turns")).alias("text"),
                       S.reference_call(F.col("function_calls")).alias("reference"),
                       F.col("function_names").alias("allowed_functions"))


def run_evaluation(corpus: DataFrame, models: dict[str, Callable], max_samples: int | None = None,
                   batch_size: int = 8) -> tuple[DataFrame, DataFrame]:
    """F11 per model, F12 scoring in one pass; returns (rounded metrics with throughput, rows).

    Each model's predictions are written once; ``inference_time_s`` is the wall
    time of that run and ``throughput_sps`` its examples per second.

    ``models`` maps a model name to a zero-argument factory returning
    ``predict(list[str]) -> list[str]``; each is loaded once per worker.
    """
    ev = materialize(eval_set(corpus, max_samples), "eval-set")
    preds, n, seconds = None, ev.count(), {}
    for name, factory in models.items():
        began = time.perf_counter()
        p = S.batch_predict(ev.select("example_id", "text"), factory, "text", batch_size=batch_size)
        p = materialize(p.select(F.lit(name).alias("model"), "example_id", "prediction"), "predictions")
        seconds[name] = time.perf_counter() - began
        preds = p if preds is None else preds.unionByName(p)
    rows = preds.join(ev.select("example_id", "reference", "allowed_functions"), "example_id")
    metrics = S.metrics_report(S.score_examples(rows))
    took = F.lit(None).cast("double")
    for name, s in seconds.items():
        took = F.when(F.col("model") == name, F.lit(s)).otherwise(took)
    return metrics.withColumn("inference_time_s", F.round(took, 1)).withColumn(
        "throughput_sps", F.round(F.lit(float(n)) / took, 1)), rows

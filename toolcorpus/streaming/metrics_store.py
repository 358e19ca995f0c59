"""Metrics of a stream, kept as partial sums: each micro-batch has its own, and replaying one replaces them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from toolcorpus.operators.scoring import finish_metrics, merge_states, metric_state


def store_batch(path: str, by=("model",)):
    """For ``foreachBatch``: writes the state of a batch of scores to the batch's own partition of ``path``.

    A batch that is run again overwrites what it wrote, so nothing counts twice.
    """
    def run(scores: DataFrame, batch_id: int) -> None:
        metric_state(scores, by).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def stored_metrics(spark: SparkSession, path: str, by=("model",)) -> DataFrame:
    """The metrics of all batches stored so far."""
    return finish_metrics(merge_states(spark.read.parquet(path), by), by)

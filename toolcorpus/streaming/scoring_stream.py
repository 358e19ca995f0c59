"""The row-wise operators on ``readStream`` sources.

Parsing (B1-B5) and per-example scoring (F7) keep no state, so they run
unchanged on a stream; the per-model report (F8) is a streaming aggregate in
``complete``/``update`` mode whose state is one small buffer per model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from toolcorpus.operators import parse as B
from toolcorpus.operators import scoring as S

DIALOGUE_SCHEMA = "example_id bigint, system string, chat string"
PREDICTION_SCHEMA = ("model string, example_id bigint, prediction string, reference string, "
                     "allowed_functions array<string>")


def parse_dialogue_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                          call_mode: str = "balanced") -> DataFrame:
    """Streaming raw dialogues -> parsed corpus rows with calls."""
    raw = spark.readStream.schema(DIALOGUE_SCHEMA).format(fmt).load(path)
    return B.keep_with_calls(B.parse_corpus(raw, call_mode))


def score_prediction_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Streaming predictions -> (per-example scores, running per-model metrics).

    ROUGE-L runs the same Arrow function as in batch.
    """
    preds = spark.readStream.schema(PREDICTION_SCHEMA).format(fmt).load(path)
    scores = S.score_examples(preds)
    return scores, S.aggregate_metrics(scores)

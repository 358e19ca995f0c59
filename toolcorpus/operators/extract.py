"""Call extraction family over model output text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from toolcorpus.functions.calls import extract_call_text, parse_call, parsed_call
from toolcorpus.functions.jsonx import is_json

# --- fixed values: extraction status labels ----------------------------------
STATUS_NONE = "no_call_found"
STATUS_INVALID = "extracted_not_json"
STATUS_VALID = "valid_call"
# ------------------------------------------------------------------------------


def extraction_status(text: Column) -> Column:
    """None / extracted-but-not-JSON / valid, via the unvalidated D1 extractor."""
    raw = extract_call_text(text)
    return (F.when(raw.isNull(), F.lit(STATUS_NONE))
            .when(is_json(raw), F.lit(STATUS_VALID))
            .otherwise(F.lit(STATUS_INVALID)))


def to_results(df: DataFrame, raw_col: str = "raw_output", latency_col: str | None = "latency_ms") -> DataFrame:
    """Inference result columns from raw generated text (inference profile, D4).

    ``function_name`` is NULL for unparseable output, ``arguments`` defaults to
    ``{}`` (Python-style JSON text), latency is rounded to 0.1 ms, ``error`` is
    declared but never set.
    """
    out = df.withColumn("_call", parsed_call(F.col(raw_col), "inference"))
    found = F.col("_call.call").isNotNull()
    latency = F.round(F.col(latency_col), 1) if latency_col else F.lit(None).cast("double")
    return out.select(
        *[c for c in df.columns if c not in (raw_col, latency_col)],
        F.col(raw_col).alias("raw_output"),
        F.when(F.col("_call.has_name"), F.coalesce("_call.name", "_call.name_json")).alias("function_name"),
        F.coalesce("_call.arguments", F.lit("{}")).alias("arguments"),
        latency.alias("latency_ms"),
        found.alias("valid"),
        F.lit(None).cast("string").alias("error"),
    )


__all__ = ["extract_call_text", "parse_call", "extraction_status", "to_results"]

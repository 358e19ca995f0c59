"""Reports over metrics and pairs: comparison table, KPI deltas, long/wide forms, improvements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from toolcorpus.operators.scoring import METRIC_ORDER, RATE_METRICS

# --- fixed values: model keys, table metrics, KPI metrics, stage names ---------
MODELS = ("base", "sft_lora", "dpo")
TABLE_METRICS = ("valid_json_rate", "exact_tool_match_rate", "parameter_f1", "hallucination_rate", "rouge_l")
KPI_METRICS = ("valid_json_rate", "exact_tool_match_rate", "hallucination_rate", "parameter_f1")
STAGES = (("base_to_sft", "base", "sft_lora"), ("sft_to_dpo", "sft_lora", "dpo"), ("base_to_dpo", "base", "dpo"))
# ------------------------------------------------------------------------------


def metrics_long(metrics: DataFrame) -> DataFrame:
    """(model, metric, value) for charts."""
    return metrics.unpivot("model", list(METRIC_ORDER), "metric", "value")


def metrics_wide(metrics: DataFrame) -> DataFrame:
    """one row per model (the metric report itself)."""
    return metrics.select("model", *METRIC_ORDER)


def _by_metric(metrics: DataFrame, names=TABLE_METRICS) -> DataFrame:
    """metric x model pivot with explicit model values (no extra job); missing -> 0.0."""
    long = metrics_long(metrics).where(F.col("metric").isin(*names))
    wide = long.groupBy("metric").pivot("model", list(MODELS)).agg(F.first("value"))
    return wide.na.fill(0.0, list(MODELS))


def comparison_table(metrics: DataFrame) -> DataFrame:
    """five metrics x three models and the base->dpo delta."""
    return _by_metric(metrics).withColumn("delta", F.col("dpo") - F.col("base")) \
        .select("metric", *MODELS, "delta")


def kpi_deltas(metrics: DataFrame) -> DataFrame:
    """dpo value and dpo - base for the four headline KPIs."""
    t = _by_metric(metrics, KPI_METRICS)
    return t.select("metric", "dpo", (F.col("dpo") - F.col("base")).alias("delta_vs_base"))


def improvements(metrics: DataFrame) -> DataFrame:
    """F16: base->sft, sft->dpo, base->dpo deltas; rates shown as ``+x.x pp``, others ``+0.xxx``."""
    t = _by_metric(metrics)
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), (F.col(b2) - F.col(a)).alias("delta"))
                       for s, a, b2 in STAGES])
    long = t.select("metric", F.explode(stages).alias("x")).select("x.stage", "metric", "x.delta")
    is_rate = F.col("metric").isin(*RATE_METRICS)
    display = F.when(is_rate, F.format_string("%+.1f pp", F.round("delta", 1))) \
        .otherwise(F.format_string("%+.3f", F.round("delta", 3)))
    return long.withColumn("display", display)


def pair_distribution(pairs: DataFrame) -> DataFrame:
    """Pairs per strategy with share of the total, plus a ``total`` row (rollup)."""
    counts = pairs.rollup("rejection_strategy").agg(F.count(F.lit(1)).cast("bigint").alias("n_pairs"))
    # the rollup output has one row per strategy plus the total: a window over it is tiny
    total = F.max(F.when(F.col("rejection_strategy").isNull(), F.col("n_pairs"))).over(Window.partitionBy())
    out = counts.withColumn("_total", total)
    return out.select(F.coalesce("rejection_strategy", F.lit("total")).alias("rejection_strategy"), "n_pairs",
                      F.coalesce(F.try_divide(F.col("n_pairs"), F.col("_total")), F.lit(0.0)).alias("share"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """Rows per split (the feature list is ``corpus.columns``)."""
    return corpus.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))

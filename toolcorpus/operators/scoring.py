"""Scoring: per-example call metrics, aggregation, throughput and the batch-predict hook."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from toolcorpus.functions.calls import parsed_call, value_tokens
from toolcorpus.functions.jsonx import decoded, py_json
from toolcorpus.functions.lcs import rouge_l_from_tokens, rouge_l_text
from toolcorpus.functions.text import py_split

RATE_METRICS = ("valid_json_rate", "exact_tool_match_rate", "hallucination_rate")
MEAN_METRICS = ("parameter_f1", "parameter_precision", "parameter_recall", "rouge_l")
METRIC_ORDER = ("valid_json_rate", "exact_tool_match_rate", "parameter_f1", "parameter_precision",
                "parameter_recall", "hallucination_rate", "rouge_l")


def reference_call(function_calls: Column) -> Column:
    """first call re-serialised like ``json.dumps``, ``""`` when there is none."""
    return F.coalesce(py_json(F.try_element_at(function_calls, F.lit(1))), F.lit(""))


def param_tokens(arguments: Column) -> Column:
    """``str(v).lower().split()`` over the values of a map of arguments (keys ignored).

    A map holds texts: what is the text of a list or an object is printed like
    one. ``score_examples`` takes the tokens from the decoded call instead,
    where a string stays a string.
    """
    def value(text):
        nested = decoded(text) if text is not None and text[:1] in ("[", "{") else None
        return nested if isinstance(nested, (list, dict)) else text

    @F.arrow_udf("array<string>")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([value_tokens(dict(enumerate(map(value, r)))) if r is not None else None for r in rows.to_pylist()],
                        pa.list_(pa.string()))

    return run(F.map_values(arguments))


def multiset_overlap(a: Column, b: Column) -> Column:
    """``sum((Counter(a) & Counter(b)).values())``, by one sort of both sides and one pass over it.

    Equal tokens follow each other, those of ``a`` first: they are counted, and
    each of ``b`` takes one of them away.
    """
    def side(tokens, n):
        return F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(n).alias("side")))

    def step(acc, x):
        left = F.when(x["t"] == acc["t"], acc["left"]).otherwise(F.lit(0))
        taken = F.when((x["side"] == 1) & (left > 0), F.lit(1)).otherwise(F.lit(0))
        return F.struct(x["t"].alias("t"), (left + F.when(x["side"] == 0, F.lit(1)).otherwise(F.lit(0)) - taken).alias("left"),
                        (acc["common"] + taken).alias("common"))

    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("left"), F.lit(0).alias("common"))
    return F.aggregate(F.array_sort(F.concat(side(a, 0), side(b, 1))), start, step, lambda acc: acc["common"])


def overlap_scores(common: Column, n_pred: Column, n_ref: Column) -> tuple[Column, Column]:
    """Precision and recall from counts; both sides empty -> (1, 1), one empty -> (0, 0)."""
    both_empty, one_empty = (n_pred == 0) & (n_ref == 0), (n_pred == 0) | (n_ref == 0)

    def share(of):
        return F.when(both_empty, 1.0).when(one_empty, 0.0).otherwise(F.try_divide(common.cast("double"), of))

    return share(n_pred), share(n_ref)


def param_precision_recall(pred_args: Column, ref_args: Column) -> tuple[Column, Column]:
    """token precision and recall of argument values, from two maps of texts.

    As one expression the tokens are built several times; ``score_examples``
    stages them as columns.
    """
    p_tok, r_tok = param_tokens(pred_args), param_tokens(ref_args)
    return overlap_scores(multiset_overlap(p_tok, r_tok), F.size(p_tok), F.size(r_tok))


def rouge_l(prediction: Column, reference: Column, method: str = "arrow") -> Column:
    """sentence ROUGE-L F1 on lower-cased whitespace tokens.

    ``arrow`` (default): one Arrow-batched UDF over the raw strings, bit-parallel
    LCS; ``sql``: JVM higher-order functions, only sensible for short texts.
    """
    if method == "arrow":
        return rouge_l_text(prediction, reference)
    return rouge_l_from_tokens(py_split(F.lower(prediction)), py_split(F.lower(reference)), method)


def score_examples(df: DataFrame, keys=("model", "example_id"), prediction: str = "prediction",
                   reference: str = "reference", allowed: str = "allowed_functions",
                   lcs_method: str = "arrow") -> DataFrame:
    """one row of per-example scores.

    ``valid_json``: the prediction parses (metrics profile). ``hallucinated``:
    parsed, allowed list non-empty and name not in it. ``tool_match``/P/R only
    when the reference parses too; everything else scores 0. ROUGE-L always
    compares the raw strings.
    """
    keys = list(keys)
    base = df.select(*keys, F.coalesce(F.col(prediction), F.lit("")).alias("_pred"),
                     F.coalesce(F.col(reference), F.lit("")).alias("_ref"),
                     F.coalesce(F.col(allowed), F.array().cast("array<string>")).alias("_allowed"))
    # Each text is scanned and decoded once.
    parsed = base.select(*keys, "_pred", "_ref", "_allowed", parsed_call(F.col("_pred"), "metrics").alias("_p"),
                         parsed_call(F.col("_ref"), "metrics").alias("_r"))
    valid = F.col("_p.call").isNotNull()
    with_ref = valid & F.col("_r.call").isNotNull()
    # Tokens, then their overlap, are columns of their own: later expressions read them instead of rebuilding them.
    parsed = parsed.withColumn("_pt", F.col("_p.tokens")).withColumn("_rt", F.col("_r.tokens"))
    parsed = parsed.withColumn("_common", multiset_overlap(F.col("_pt"), F.col("_rt")))
    p, r = overlap_scores(F.col("_common"), F.size("_pt"), F.size("_rt"))
    # A name that is no string is in no list of names.
    halluc = valid & (F.size("_allowed") > 0) & ~F.coalesce(F.array_contains("_allowed", F.col("_p.name")), F.lit(False))
    return parsed.select(
        *keys,
        valid.alias("valid_json"),
        F.coalesce(with_ref & (F.col("_p.name_json") == F.col("_r.name_json")), F.lit(False)).alias("tool_match"),
        F.coalesce(halluc, F.lit(False)).alias("hallucinated"),
        F.when(with_ref, p).otherwise(F.lit(0.0)).alias("precision"),
        F.when(with_ref, r).otherwise(F.lit(0.0)).alias("recall"),
        rouge_l(F.col("_pred"), F.col("_ref"), lcs_method).alias("rouge_l"),
    )


_SUMS = {"valid_json_rate": "valid_json", "exact_tool_match_rate": "tool_match", "hallucination_rate": "hallucinated",
         "parameter_precision": "precision", "parameter_recall": "recall", "rouge_l": "rouge_l"}
STATE_COLUMNS = ("n", *(f"sum_{c}" for c in _SUMS.values()))


def metric_state(scores: DataFrame, by=("model",)) -> DataFrame:
    """F8 as a state that can be kept: the number of examples and the sum of every score, per group.

    Partial aggregation runs map-side; only one small buffer per group and
    partition is shuffled. With ``by=()`` the single row also exists for n=0.
    """
    sums = [F.coalesce(F.sum(F.col(c).cast("int" if m in RATE_METRICS else "double")), F.lit(0)).alias(f"sum_{c}") for m, c in _SUMS.items()]
    aggs = [F.count(F.lit(1)).cast("bigint").alias("n"), *sums]
    return scores.groupBy(*by).agg(*aggs) if by else scores.agg(*aggs)


def merge_states(states: DataFrame, by=("model",)) -> DataFrame:
    """The state of all examples from the states of parts of them, in any order and grouping."""
    aggs = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATE_COLUMNS]
    return states.groupBy(*by).agg(*aggs) if by else states.agg(*aggs)


def finish_metrics(state: DataFrame, by=("model",)) -> DataFrame:
    """F8 from a state: rates in percent of n, means over n (failures count 0), F1 of the two means."""
    def mean(metric):
        scale = 100.0 if metric in RATE_METRICS else 1.0
        return F.coalesce(F.try_divide(scale * F.col(f"sum_{_SUMS[metric]}"), F.col("n")), F.lit(0.0)).alias(metric)

    out = state.select(*by, "n", *[mean(m) for m in _SUMS])
    p, r = F.col("parameter_precision"), F.col("parameter_recall")
    out = out.withColumn("parameter_f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    return out.select(*by, "n", *METRIC_ORDER)


def aggregate_metrics(scores: DataFrame, by=("model",)) -> DataFrame:
    """F8 in one pass: ``finish_metrics(metric_state(scores))``."""
    return finish_metrics(metric_state(scores, by), by)


def round_report(metrics: DataFrame) -> DataFrame:
    """rates to 2 decimals, the other metrics to 4."""
    out = metrics
    for c in METRIC_ORDER:
        if c in metrics.columns:
            out = out.withColumn(c, F.round(c, 2 if c in RATE_METRICS else 4))
    return out


def metrics_report(scores: DataFrame, by=("model",)) -> DataFrame:
    return round_report(aggregate_metrics(scores, by))


def throughput_report(results: DataFrame, by=("model",), latency_col: str = "latency_ms") -> DataFrame:
    """elapsed seconds and samples/second (1 decimal) from logged per-call latency."""
    secs = F.sum(latency_col) / 1000.0
    out = results.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("n"), secs.alias("_s"))
    return out.select(*by, "n", F.round("_s", 1).alias("inference_time_s"),
                      F.round(F.coalesce(F.try_divide(F.col("n"), F.col("_s")), F.lit(0.0)), 1)
                      .alias("throughput_sps"))


def wall_time(intervals: DataFrame, by=("model",), start: str = "start_ms", end: str = "end_ms",
              bucket_ms: int = 3_600_000) -> DataFrame:
    """F10 from logged starts and ends (milliseconds): ``n, busy_s, throughput_sps``, where overlapping calls count once.

    ``busy_s`` is the length of the union of a group's intervals. They are cut at
    multiples of ``bucket_ms``; the union is found by a sweep inside each
    bucket, where it is new what lies beyond all ends so far, and the buckets
    add up. So a group of any size is spread over its hours. Intervals without a
    start or an end, or that end before they start, count in ``n`` only.
    """
    by = list(by)
    rows = intervals.select(*by, F.col(start).cast("bigint").alias("__a"), F.col(end).cast("bigint").alias("__b"))
    real = rows.where(F.col("__b") > F.col("__a"))
    first, last = F.floor(F.col("__a") / bucket_ms).cast("bigint"), F.floor((F.col("__b") - 1) / bucket_ms).cast("bigint")
    cut = real.select(*by, "__a", "__b", F.explode(F.sequence(first, last)).alias("__bucket"))
    cut = cut.select(*by, "__bucket", F.greatest("__a", F.col("__bucket") * bucket_ms).alias("__a"),
                     F.least("__b", (F.col("__bucket") + 1) * bucket_ms).alias("__b")).distinct()
    before = Window.partitionBy(*by, "__bucket").orderBy("__a", "__b").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("__b").over(before), F.col("__a"))
    fresh = cut.select(*by, F.greatest(F.lit(0), F.col("__b") - F.greatest("__a", seen)).alias("ms"))
    busy = fresh.groupBy(*by).agg(F.sum("ms").alias("ms"))
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    out = counts.alias("c").join(busy.alias("b"), reduce(and_, same), "left")
    seconds = F.coalesce(F.col("ms"), F.lit(0)) / 1000.0
    return out.select(*[F.col(f"c.{c}") for c in by], "n", F.round(seconds, 1).alias("busy_s"),
                      F.round(F.coalesce(F.try_divide(F.col("n"), seconds), F.lit(0.0)), 1).alias("throughput_sps"))


def batch_predict(df: DataFrame, make_predict_fn: Callable[[], Callable[[list[str]], list[str]]],
                  prompt_col: str = "text", out_col: str = "prediction", batch_size: int = 8) -> DataFrame:
    """batched completion of a prompt column by a caller-supplied model.

    ``make_predict_fn`` is called once per Python worker process and kept there
    (``predict_batch_udf``); prompts go to the model ``batch_size`` at a time in
    order. A null prompt is an empty one.
    """
    from pyspark.ml.functions import predict_batch_udf

    def make():
        fn = make_predict_fn()
        return lambda prompts: np.array(fn([str(p) for p in prompts]), dtype=object)

    predict = predict_batch_udf(make, return_type=T.StringType(), batch_size=batch_size)
    return df.withColumn(out_col, predict(F.coalesce(F.col(prompt_col), F.lit(""))))


def compare_models(predictions: dict[str, DataFrame], references: DataFrame,
                   key: str = "example_id", lcs_method: str = "arrow") -> DataFrame:
    """score every model on all references in one pass.

    Every reference counts for every model: references are repeated per model
    and left-joined to the predictions on ``key``; a missing prediction is an
    empty text, so it lowers the rates instead of the number of examples.
    """
    preds = None
    for name, p in predictions.items():
        p = p.select(F.lit(name).alias("model"), key, "prediction")
        preds = p if preds is None else preds.unionByName(p)
    every = references.withColumn("model", F.explode(F.array(*[F.lit(n) for n in predictions])))
    rows = every.join(preds, ["model", key], "left")
    return metrics_report(score_examples(rows, ("model", key), lcs_method=lcs_method))

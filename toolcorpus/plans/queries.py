"""Registered queries: one per operator family, each over the driver's whole tables.

Every query reads ``conversations``/``events`` (or data Spark derives from
them), so its work grows with the tables. Column names match the oracle SQL in
``plans.oracle_sql``; doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from toolcorpus.functions.calls import extract_call_text, parse_call
from toolcorpus.operators import pairs as E
from toolcorpus.operators import parse as B
from toolcorpus.operators import prompts as PR
from toolcorpus.operators import reports as R
from toolcorpus.operators import scoring as S
from toolcorpus.operators.extract import extraction_status, to_results
from toolcorpus.plans.evaluation import run_evaluation
from toolcorpus.plans.preference import preference_dataset
from toolcorpus.plans.sft import build_corpus, sft_dataset
from toolcorpus.plans.stages import materialize, shared_path
from toolcorpus.sources import catalog as CAT
from toolcorpus.sources import dialogues as DLG
from toolcorpus.sources import experiment as EXP
from toolcorpus.sources import fixtures as FX
from toolcorpus.sources import positions as POS
from toolcorpus.sources.incremental import read_refreshed, refresh_corpus

SPLIT_RATIO = 0.05
SEED = 42
HEAD_ROWS = 25
EVAL_SAMPLE = 1000
CAP_TOKENS = 64
MAX_TOKENS = 2048


def _r6(c):
    return F.round(F.col(c).cast("double"), 6).alias(c)


def corpus(spark: SparkSession, sf: str, call_mode: str = "balanced") -> DataFrame:
    return B.parse_corpus(FX.raw_dialogues(spark, sf), call_mode)


def _split(spark, sf):
    return B.split_corpus(B.keep_with_calls(corpus(spark, sf)), SPLIT_RATIO, SEED, "exact")


def _scores(spark, sf):
    return S.score_examples(FX.eval_rows(spark, sf))


def _metrics(spark, sf):
    return S.metrics_report(_scores(spark, sf))


def q_parse_turns(spark, sf):
    return B.explode_turns(corpus(spark, sf))


def q_extract_schemas(spark, sf):
    c = corpus(spark, sf)
    return c.select("example_id", F.posexplode(F.arrays_zip(F.col("function_names").alias("n"),
                                                            F.col("functions").alias("s"))).alias("fn_idx", "z")) \
        .select("example_id", F.col("fn_idx").cast("bigint"), F.col("z.n").alias("function_name"),
                F.col("z.s").alias("schema_json"))


def _calls(mode):
    def q(spark, sf):
        return corpus(spark, sf, mode).select("example_id", F.posexplode("function_calls").alias("call_idx", "call")) \
            .select("example_id", F.col("call_idx").cast("bigint"), "call")
    return q


def q_corpus_filter(spark, sf):
    return B.keep_with_calls(corpus(spark, sf)).select(
        "example_id", F.col("num_turns").cast("bigint"), F.size("functions").cast("bigint").alias("num_functions"),
        F.size("function_calls").cast("bigint").alias("num_calls"), "has_function_call")


def q_corpus_head(spark, sf):
    return B.parse_corpus(B.head(FX.raw_dialogues(spark, sf), HEAD_ROWS)).select(
        "example_id", F.col("num_turns").cast("bigint"), "has_function_call")


def _split_hash(mode):
    def q(spark, sf):
        return B.split_corpus(B.keep_with_calls(corpus(spark, sf, mode)), SPLIT_RATIO, SEED, "hash").select("example_id", "split")
    return q


def q_split_exact(spark, sf):
    return _split(spark, sf).select("example_id", "split")


def q_corpus_stats(spark, sf):
    return R.corpus_stats(_split(spark, sf))


def q_system_prompt(spark, sf):
    return PR.with_system_prompt(corpus(spark, sf)).select("example_id", "system_prompt")


def q_system_prompt_compact(spark, sf):
    return PR.with_system_prompt(corpus(spark, sf), "compact").select("example_id", "system_prompt")


def q_chatml_text(spark, sf):
    return PR.sft_text(corpus(spark, sf)).select("example_id", "text")


def q_eval_prompt(spark, sf):
    c = corpus(spark, sf)
    return c.select("example_id", PR.eval_prompt(F.col("functions"), F.col("turns")).alias("text"))


def q_pair_prompt(spark, sf):
    c = corpus(spark, sf)
    return c.select("example_id", PR.pair_prompt(F.col("functions"), F.col("turns")).alias("prompt"))


def _user_turns(spark, sf):
    c = corpus(spark, sf)
    return c.select("example_id", "functions", F.posexplode("turns").alias("turn_idx", "t")) \
        .where(F.col("t.role") == "user")


def q_inference_prompt(spark, sf):
    u = _user_turns(spark, sf)
    return u.select("example_id", F.col("turn_idx").cast("bigint"),
                    PR.inference_prompt(F.col("t.content"), F.col("functions")).alias("prompt"))


def q_preview_prompt(spark, sf):
    u = _user_turns(spark, sf)
    return u.select("example_id", F.col("turn_idx").cast("bigint"),
                    PR.preview_prompt(F.col("t.content"), F.col("functions")).alias("prompt"))


def q_select_functions(spark, sf):
    called = corpus(spark, sf).select(F.explode("function_calls").alias("c")) \
        .select(F.get_json_object("c", "$.name").alias("name"))
    return CAT.select_functions(FX.tool_catalog(spark, sf), called).select("tool_idx", "name")


def q_catalog_params(spark, sf):
    cat = CAT.catalog_from_json(FX.tool_catalog(spark, sf).drop("name"), "schema_json")
    return CAT.catalog_params(cat).select("function", "param_idx", "param", "type", "required")


def q_sample_calls(spark, sf):
    cat = CAT.catalog_from_json(FX.tool_catalog(spark, sf).drop("name"), "schema_json")
    return E.sample_calls(cat)


def q_extract_call_text(spark, sf):
    return FX.eval_rows(spark, sf).select("model", "example_id",
                                          extract_call_text(F.col("prediction")).alias("call_text"))


def _parse(profile):
    def q(spark, sf):
        return FX.eval_rows(spark, sf).select("model", "example_id",
                                              parse_call(F.col("prediction"), profile).alias("call"))
    return q


def q_extraction_status(spark, sf):
    return FX.eval_rows(spark, sf).select("model", "example_id", extraction_status(F.col("prediction")).alias("status"))


def q_results_table(spark, sf):
    ev = FX.eval_rows(spark, sf).select("model", "example_id", F.col("prediction").alias("raw_output"), "latency_ms")
    return to_results(ev).select("model", "example_id", "raw_output", "function_name", "arguments",
                                 "latency_ms", "valid")


def q_param_pr(spark, sf):
    return _scores(spark, sf).select("model", "example_id", _r6("precision"), _r6("recall"))


def q_rouge_l(spark, sf):
    return _scores(spark, sf).select("model", "example_id", _r6("rouge_l"))


def q_score_examples(spark, sf):
    return _scores(spark, sf).select("model", "example_id", "valid_json", "tool_match", "hallucinated",
                                     _r6("precision"), _r6("recall"), _r6("rouge_l"))


def q_metrics_report(spark, sf):
    return _metrics(spark, sf)


def q_metrics_long(spark, sf):
    return R.metrics_long(_metrics(spark, sf)).select("model", "metric", _r6("value"))


def q_comparison_table(spark, sf):
    t = R.comparison_table(_metrics(spark, sf))
    return t.select("metric", _r6("base"), _r6("sft_lora"), _r6("dpo"), _r6("delta"))


def q_kpi_deltas(spark, sf):
    return R.kpi_deltas(_metrics(spark, sf)).select("metric", _r6("dpo"), _r6("delta_vs_base"))


def q_improvements(spark, sf):
    return R.improvements(_metrics(spark, sf)).select("stage", "metric", _r6("delta"), "display")


def q_throughput_report(spark, sf):
    return S.throughput_report(FX.eval_rows(spark, sf))


def q_build_pairs(spark, sf):
    return E.build_pairs(FX.pair_input(spark, sf), SEED)


def _forced(strategy):
    def q(spark, sf):
        return E.build_pairs(FX.pair_input(spark, sf), SEED, strategy=strategy)
    return q


def q_pairs_drawn(spark, sf):
    return E.build_pairs(FX.pair_input(spark, sf), SEED, random_choice=True)


def q_compare_models(spark, sf):
    rows = FX.eval_rows(spark, sf)
    preds = {m: rows.where(F.col("model") == m).select("example_id", "prediction") for m in ("base", "sft_lora", "dpo")}
    refs = rows.where(F.col("model") == "base").select("example_id", "reference", "allowed_functions")
    return S.compare_models(preds, refs)


def q_metrics_wide(spark, sf):
    return R.metrics_wide(_metrics(spark, sf))


def q_pair_distribution(spark, sf):
    return R.pair_distribution(E.build_pairs(FX.pair_input(spark, sf), SEED)) \
        .select("rejection_strategy", "n_pairs", _r6("share"))


def _pair_examples(mode):
    def q(spark, sf):
        return E.pair_examples(corpus(spark, sf, mode)).select(
            "example_id", "prompt", "completion", F.array_join("available_functions", ",").alias("available_functions"))
    return q


def _validation(spark, sf):
    return _split(spark, sf).where(F.col("split") == "validation")


def q_reference_calls(spark, sf):
    return _references(_validation(spark, sf))


def q_eval_sample(spark, sf):
    """The cap is the feature here: the first rows of the validation split."""
    return _references(B.head(_validation(spark, sf), EVAL_SAMPLE))


def _references(v):
    return v.select("example_id", S.reference_call(F.col("function_calls")).alias("reference"),
                    F.array_join("function_names", ",").alias("allowed_functions"))


def first_tool_predictor():
    """Deterministic stand-in model: calls the first function named in the prompt."""
    import re

    pat = re.compile(r'"name": "([^"]+)"')

    def predict(prompts):
        out = []
        for p in prompts:
            m = pat.search(p)
            out.append('{"name": "%s", "arguments": {}}' % m.group(1) if m else "no tool")
        return out

    return predict


def q_batch_predict(spark, sf):
    v = _split(spark, sf).where(F.col("split") == "validation")
    prompts = v.select("example_id", PR.eval_prompt(F.col("functions"), F.col("turns")).alias("text"))
    return S.batch_predict(prompts, first_tool_predictor, "text").select("example_id", "prediction")


def q_cap_length(spark, sf):
    t = PR.sft_text(corpus(spark, sf)).select("example_id", "text")
    return PR.cap_length(t, "text", CAP_TOKENS).select("example_id", "n_tokens", "truncated", "text")


def q_cap_length_2048(spark, sf):
    t = PR.sft_text(corpus(spark, sf)).select("example_id", "text")
    return PR.cap_length(t, "text", MAX_TOKENS).select("example_id", "n_tokens", "truncated", "text")


def q_pack_sequences(spark, sf):
    t = PR.sft_text(corpus(spark, sf)).select("example_id", "text")
    return PR.pack_sequences(t, MAX_TOKENS)


def q_pack_whole(spark, sf):
    t = PR.sft_text(corpus(spark, sf)).select("example_id", "text")
    return PR.pack_whole(t, MAX_TOKENS)


def q_metrics_merged(spark, sf):
    """States of the predictions by request, merged per model."""
    parts = S.metric_state(_scores(spark, sf), ("model", "example_id"))
    return S.round_report(S.finish_metrics(S.merge_states(parts)))


def q_wall_time(spark, sf):
    """Each event as a logged call that began at its time and took its value in seconds."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_type").alias("model"), F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ms"),
        F.round(F.col("value") * 1000).cast("bigint").alias("took"))
    return S.wall_time(ev.select("model", "start_ms", (F.col("start_ms") + F.col("took")).alias("end_ms")))


# -- positions -------------------------------------------------------------------

def q_head_source_order(spark, sf):
    return POS.first_in_source_order(spark, f"{sf}/events.parquet", HEAD_ROWS, "event_id", "event_type")


def q_align_positional(spark, sf):
    said = POS.read_positioned(spark, f"{sf}/conversations.parquet", "conv_id", "turn")
    return POS.align_positional(said, POS.read_positioned(spark, f"{sf}/events.parquet", "event_id"))


# -- the chains end to end ---------------------------------------------------------

def q_sft_dataset(spark, sf):
    return sft_dataset(build_corpus(FX.raw_dialogues(spark, sf), SPLIT_RATIO, SEED))


def q_preference_dataset(spark, sf):
    return preference_dataset(build_corpus(FX.raw_dialogues(spark, sf), SPLIT_RATIO, SEED), SEED)


def silent_predictor():
    """Deterministic stand-in model that never calls a function."""
    return lambda prompts: ["no call"] * len(prompts)


def q_run_evaluation(spark, sf):
    """Without the two columns of the clock."""
    corpus_ = build_corpus(FX.raw_dialogues(spark, sf), SPLIT_RATIO, SEED)
    metrics, _ = run_evaluation(corpus_, {"first_tool": first_tool_predictor, "silent": silent_predictor})
    return metrics.drop("inference_time_s", "throughput_sps")


def q_refresh_corpus(spark, sf):
    """The corpus saved, then refreshed with the same dialogues."""
    path = shared_path(spark, "refreshed-corpus")
    raw = materialize(FX.raw_dialogues(spark, sf), "dialogues")
    refresh_corpus(raw, path, buckets=16)
    refresh_corpus(raw, path, buckets=16)
    return read_refreshed(spark, path).select(
        "example_id", F.col("num_turns").cast("bigint"), F.size("functions").cast("bigint").alias("num_functions"),
        F.size("function_calls").cast("bigint").alias("num_calls"), "has_function_call")


# -- sources and sinks: written to the shared folder, then read back ------------

def q_read_dialogues(spark, sf):
    path = shared_path(spark, "dialogues")
    FX.raw_dialogues(spark, sf).write.parquet(path)
    return DLG.read_dialogues(spark, path)


def q_read_corpus(spark, sf):
    path = shared_path(spark, "corpus")
    c = B.split_corpus(B.keep_with_calls(corpus(spark, sf)), SPLIT_RATIO, SEED, "hash")
    DLG.write_corpus(c, path)
    return DLG.read_corpus(spark, path, "train").select("example_id", "split", F.col("num_turns").cast("bigint"))


def q_read_catalog(spark, sf):
    path = shared_path(spark, "catalog")
    tools = FX.tool_catalog(spark, sf)  # a dimension: one document, as the format wants
    doc = tools.agg(F.array_sort(F.collect_list(F.struct("tool_idx", "schema_json"))).alias("t")).select(
        F.concat(F.lit("["), F.array_join(F.transform("t", lambda x: x["schema_json"]), ",\n"), F.lit("]")).alias("value"))
    doc.coalesce(1).write.text(path)
    return CAT.read_catalog(spark, path).select(F.col("function_idx").cast("bigint"), "name", "description")


def q_read_stats(spark, sf):
    path = shared_path(spark, "stats")
    c = B.split_corpus(B.keep_with_calls(corpus(spark, sf)), SPLIT_RATIO, SEED, "hash")
    EXP.write_stats(R.corpus_stats(c), c.columns, path)
    doc = spark.read.schema("splits map<string,bigint>, features array<string>").json(path)
    return doc.select(F.explode("splits").alias("split", "n_rows"), F.array_join("features", ",").alias("features"))


def q_read_report(spark, sf):
    path = shared_path(spark, "report")
    EXP.write_report(_metrics(spark, sf), path, "base", "events", 0)
    return EXP.read_experiment(spark, path).select("model", "metric", _r6("value"))


def q_experiment_configs(spark, sf):
    path = shared_path(spark, "experiment")
    m = _metrics(spark, sf).select("model", F.struct(F.struct("valid_json_rate", "rouge_l").alias("rates"), F.col("n").alias("examples")).alias("r"))
    m.agg(F.map_from_entries(F.collect_list(F.struct("model", "r"))).alias("results")).coalesce(1).write.json(path)
    return EXP.experiment_configs(spark, path).select("model", "section", "key", F.round(F.col("value").cast("double"), 6).alias("value"))


def _experiment_document(spark, sf):
    """An experiment document of the models' metrics: results, rates by model as sections, and one observation per model."""
    path = shared_path(spark, "experiment")
    m = _metrics(spark, sf)
    said = F.concat(F.col("model"), F.lit(": "), F.col("n").cast("string"), F.lit(" examples"))
    doc = m.agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("n")))).alias("results"),
                F.map_from_entries(F.collect_list(F.struct("model", F.col("n").cast("string")))).alias("examples"),
                F.map_from_entries(F.collect_list(F.struct("model", "valid_json_rate"))).alias("valid_json"),
                F.transform(F.array_sort(F.collect_list(F.struct("model", said.alias("said")))), lambda x: x["said"]).alias("observations"))
    doc.coalesce(1).write.json(path)  # one row per model
    return path


def q_observations(spark, sf):
    return EXP.observations(spark, _experiment_document(spark, sf)).select(F.col("idx").cast("bigint"), "observation")


def q_experiment_sections(spark, sf):
    return EXP.experiment_sections(spark, _experiment_document(spark, sf)).select(
        "section", "key", F.round(F.col("value").cast("double"), 6).alias("value"))


def q_read_pairs(spark, sf):
    path = shared_path(spark, "pairs")
    DLG.write_pairs(E.build_pairs(FX.pair_input(spark, sf), SEED), path)
    return DLG.read_pairs(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_turns": q_parse_turns,
    "extract_schemas": q_extract_schemas,
    "extract_calls_balanced": _calls("balanced"),
    "extract_calls_lazy": _calls("lazy"),
    "corpus_filter": q_corpus_filter,
    "corpus_head": q_corpus_head,
    "split_hash": _split_hash("balanced"),
    "split_hash_lazy": _split_hash("lazy"),
    "split_exact": q_split_exact,
    "corpus_stats": q_corpus_stats,
    "system_prompt": q_system_prompt,
    "system_prompt_compact": q_system_prompt_compact,
    "chatml_text": q_chatml_text,
    "eval_prompt": q_eval_prompt,
    "pair_prompt": q_pair_prompt,
    "inference_prompt": q_inference_prompt,
    "preview_prompt": q_preview_prompt,
    "select_functions": q_select_functions,
    "catalog_params": q_catalog_params,
    "sample_calls": q_sample_calls,
    "extract_call_text": q_extract_call_text,
    "parse_call_pairs": _parse("pairs"),
    "parse_call_metrics": _parse("metrics"),
    "parse_call_inference": _parse("inference"),
    "extraction_status": q_extraction_status,
    "results_table": q_results_table,
    "param_pr": q_param_pr,
    "rouge_l": q_rouge_l,
    "score_examples": q_score_examples,
    "metrics_report": q_metrics_report,
    "metrics_long": q_metrics_long,
    "comparison_table": q_comparison_table,
    "kpi_deltas": q_kpi_deltas,
    "improvements": q_improvements,
    "throughput_report": q_throughput_report,
    "build_pairs": q_build_pairs,
    "pairs_wrong_function": _forced("wrong_function"),
    "pairs_wrong_params": _forced("wrong_params"),
    "pairs_missing_params": _forced("missing_params"),
    "pairs_hallucinate": _forced("hallucinate"),
    "pair_distribution": q_pair_distribution,
    "pair_examples": _pair_examples("balanced"),
    "pair_examples_lazy": _pair_examples("lazy"),
    "reference_calls": q_reference_calls,
    "eval_sample": q_eval_sample,
    "compare_models": q_compare_models,
    "metrics_wide": q_metrics_wide,
    "pairs_drawn": q_pairs_drawn,
    "batch_predict": q_batch_predict,
    "cap_length": q_cap_length,
    "pack_sequences": q_pack_sequences,
    "read_dialogues": q_read_dialogues,
    "read_corpus": q_read_corpus,
    "read_catalog": q_read_catalog,
    "read_stats": q_read_stats,
    "read_report": q_read_report,
    "experiment_configs": q_experiment_configs,
    "read_pairs": q_read_pairs,
    "cap_length_2048": q_cap_length_2048,
    "pack_whole": q_pack_whole,
    "metrics_merged": q_metrics_merged,
    "wall_time": q_wall_time,
    "head_source_order": q_head_source_order,
    "align_positional": q_align_positional,
    "sft_dataset": q_sft_dataset,
    "preference_dataset": q_preference_dataset,
    "run_evaluation": q_run_evaluation,
    "refresh_corpus": q_refresh_corpus,
    "observations": q_observations,
    "experiment_sections": q_experiment_sections,
}

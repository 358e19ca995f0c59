"""Sinks/readers (write -> read equality), end-to-end plans and the streaming entry points."""

import json
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from toolcorpus.operators import parse as B
from toolcorpus.plans import evaluation, preference, sft
from toolcorpus.plans.queries import first_tool_predictor
from toolcorpus.sources import dialogues, experiment
from toolcorpus.sources import fixtures as FX
from toolcorpus.streaming import parse_dialogue_stream, score_prediction_stream


def test_corpus_roundtrip_and_plans(spark):
    raw = FX.raw_dialogues(spark, SF_SMALL)
    corpus = sft.build_corpus(raw, ratio=0.2)
    n = corpus.count()
    assert n == B.keep_with_calls(B.parse_corpus(raw)).count() and n > 0
    path = tempfile.mkdtemp(prefix="corpus-", dir="/tmp")
    dialogues.write_corpus(corpus, path)
    train = dialogues.read_corpus(spark, path, "train")
    val = dialogues.read_corpus(spark, path, "validation")
    assert train.count() + val.count() == n and val.count() == -(-n * 2 // 10)
    assert sft.sft_dataset(corpus, "train").where(~F.col("text").startswith("<|im_start|>system\n")).count() == 0
    pairs = preference.preference_dataset(corpus)
    assert 0 < pairs.count() <= train.count()
    metrics, _ = evaluation.run_evaluation(corpus, {"stub": first_tool_predictor, "stub2": first_tool_predictor})
    rows = metrics.collect()
    assert len(rows) == 2 and all(r["n"] == val.count() for r in rows)


def test_report_roundtrip(spark):
    from toolcorpus.plans.queries import q_metrics_report

    m = q_metrics_report(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="report-", dir="/tmp") + "/results"
    experiment.write_report(m, path, "base-model", "fixture", 1000)
    back = {(r["model"], r["metric"]): r["value"] for r in experiment.read_experiment(spark, path).collect()}
    for r in m.collect():
        assert back[(r["model"], "valid_json_rate")] == r["valid_json_rate"]
        assert back[(r["model"], "n")] == r["n"]


def test_experiment_configs(spark):
    doc = {"results": {"sft_lora": {"n": 10, "valid_json_rate": 90.0, "lora_config": {"r": 16, "lora_alpha": 32}},
                       "dpo": {"n": 10, "dpo_config": {"beta": 0.1}, "hardware": "4 cards", "own_section": {"x": [1, 2]}}},
           "improvements": {"sft": {"rouge_l": "+0.1"}},
           "observations": ["first", "second"]}
    path = tempfile.mkdtemp(prefix="exp-", dir="/tmp") + "/doc.json"
    with open(path, "w") as fh:
        json.dump(doc, fh, indent=2)
    cfg = {(r["model"], r["section"], r["key"]): r["value"] for r in experiment.experiment_configs(spark, path).collect()}
    assert cfg[("dpo", "", "hardware")] == "4 cards" and cfg[("dpo", "own_section", "x")] == "[1,2]"
    assert [tuple(r) for r in experiment.experiment_sections(spark, path).collect()] == [("improvements", "sft", '{"rouge_l":"+0.1"}')]
    assert cfg[("sft_lora", "lora_config", "r")] == "16" and cfg[("dpo", "dpo_config", "beta")] == "0.1"
    obs = [r["observation"] for r in experiment.observations(spark, path).orderBy("idx").collect()]
    assert obs == ["first", "second"]


def test_streaming_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="stream-src-", dir="/tmp")
    raw = FX.raw_dialogues(spark, SF_SMALL)
    raw.write.mode("overwrite").parquet(src + "/d")
    stream = parse_dialogue_stream(spark, src + "/d")
    q = stream.writeStream.format("memory").queryName("parsed_stream").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("parsed_stream").count()
    assert got == B.keep_with_calls(B.parse_corpus(raw)).count()


def test_streaming_scores(spark):
    src = tempfile.mkdtemp(prefix="stream-ev-", dir="/tmp")
    ev = FX.eval_rows(spark, SF_SMALL).drop("latency_ms")
    ev.write.mode("overwrite").parquet(src + "/e")
    _, metrics = score_prediction_stream(spark, src + "/e")
    q = metrics.writeStream.format("memory").queryName("metrics_stream").outputMode("complete") \
        .trigger(availableNow=True).start()
    q.awaitTermination(180)
    rows = {r["model"]: r for r in spark.table("metrics_stream").collect()}
    assert set(rows) == {"base", "sft_lora", "dpo"} and all(r["n"] == ev.count() // 3 for r in rows.values())

"""Scores on inputs of our own, with independent checks (enumeration, Counter, plain Python)."""

import itertools
import json
import random
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from toolcorpus.functions.lcs import lcs_bits, rouge_l_py
from toolcorpus.operators import scoring as S

ROWS = "model string, example_id bigint, prediction string, reference string, allowed_functions array<string>"


def plain_tokens(arguments):
    """Tokens by the rule: str(value), lower case, split; JSON quotes stand for Python's."""
    shown = [str(v) if not isinstance(v, list | dict) else json.dumps(v, ensure_ascii=False).replace("null", "None") for v in arguments.values()]
    return [t for s in shown for t in s.lower().split()]


def plain_scores(pred, ref):
    p, r = plain_tokens(pred), plain_tokens(ref)
    if not p and not r:
        return 1.0, 1.0
    common = sum((Counter(p) & Counter(r)).values())
    return (common / len(p), common / len(r)) if p and r else (0.0, 0.0)


def test_parameter_precision_and_recall_follow_the_printed_values(spark):
    sets = [{}, {"city": "Oslo"}, {"city": "Oslo east", "n": 4}, {"flag": True, "gap": None}, {"text": "true none"}, {"l": ["t1", "x"]},
            {"l": ["t1", "y", None]}, {"o": {"a": 1, "b": [2, 3]}, "city": "oslo"}, {"f": 2.5, "e": []}]
    cases = list(itertools.product(sets, sets))
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    p, r = S.param_precision_recall(F.from_json("a", "map<string,string>"), F.from_json("b", "map<string,string>"))
    for row in df.select("i", p.alias("p"), r.alias("r")).collect():
        assert (row["p"], row["r"]) == pytest.approx(plain_scores(*cases[row["i"]])), cases[row["i"]]


def longest_common(a, b):
    """By enumeration: the longest subsequence of ``a`` that ``b`` has too."""
    def inside(part):
        rest = iter(b)
        return all(x in rest for x in part)

    return next(n for n in range(len(a), -1, -1) if any(inside(c) for c in itertools.combinations(a, n)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("xyz"), max_size=9), st.lists(st.sampled_from("xyz"), max_size=9))
def test_bit_parallel_length_matches_enumeration(a, b):
    assert lcs_bits(a, b) == longest_common(a, b)


@pytest.mark.parametrize("method", ["arrow", "sql"])
def test_rouge_of_both_forms(spark, method):
    rng = random.Random(21)
    texts = [" ".join(rng.choices(["up", "Up", "down", "left", "right"], k=rng.randrange(9))) for _ in range(60)]
    pairs = list(zip(texts, reversed(texts), strict=True)) + [("one two three four", "one three"), ("", "a"), ("a", "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("i", S.rouge_l(F.col("a"), F.col("b"), method).alias("x")).collect():
        a, b = (t.lower().split() for t in pairs[r["i"]])
        n = longest_common(a, b)
        want = 2 * n / (len(a) + len(b)) if n else 0.0
        assert r["x"] == pytest.approx(want) == pytest.approx(rouge_l_py(*pairs[r["i"]]))


def test_scores_and_report_of_a_mixed_run(spark):
    ref = json.dumps({"name": "dim_lights", "arguments": {"room": "attic", "level": 30}})
    answers = [ref, '{"name": "dim_lights", "arguments": {"room": "attic"}}', '{"name": "blow_fuse", "arguments": {}}', "I would rather not."]
    df = spark.createDataFrame([("m", i, a, ref, ["dim_lights"]) for i, a in enumerate(answers)], ROWS)
    rows = {r["example_id"]: r for r in S.score_examples(df).collect()}
    assert [rows[i]["valid_json"] for i in range(4)] == [True, True, True, False]
    assert [rows[i]["tool_match"] for i in range(4)] == [True, True, False, False]
    assert [rows[i]["hallucinated"] for i in range(4)] == [False, False, True, False]
    assert [(rows[i]["precision"], rows[i]["recall"]) for i in range(4)] == [(1, 1), (1, 0.5), (0, 0), (0, 0)]
    m = S.metrics_report(S.score_examples(df)).first()
    assert (m["n"], m["valid_json_rate"], m["exact_tool_match_rate"], m["hallucination_rate"]) == (4, 75.0, 50.0, 25.0)
    assert (m["parameter_precision"], m["parameter_recall"], m["parameter_f1"]) == (0.5, 0.375, 0.4286)
    empty = S.aggregate_metrics(S.score_examples(df.limit(0)), by=()).first()
    assert empty["n"] == 0 and empty["valid_json_rate"] == empty["parameter_f1"] == 0.0


def test_reference_call_is_reserialised(spark):
    df = spark.createDataFrame([(['{"name":"f","arguments":{"é":[1,2]}}', "x"],), ([],), (None,)], "c array<string>")
    got = [r["x"] for r in df.select(S.reference_call(F.col("c")).alias("x")).collect()]
    assert got == [json.dumps({"name": "f", "arguments": {"é": [1, 2]}}), "", ""]


def test_every_reference_counts_for_every_model(spark):
    refs = spark.createDataFrame([(i, '{"name": "f", "arguments": {}}', ["f"]) for i in range(10)], "example_id bigint, reference string, allowed_functions array<string>")
    full = spark.createDataFrame([(i, '{"name": "f", "arguments": {}}') for i in range(10)], "example_id bigint, prediction string")
    got = {r["model"]: r for r in S.compare_models({"all": full, "some": full.where("example_id < 3")}, refs).collect()}
    assert (got["all"]["n"], got["all"]["valid_json_rate"]) == (10, 100.0)
    assert (got["some"]["n"], got["some"]["valid_json_rate"]) == (10, 30.0)


def test_models_load_once_per_worker(spark, tmp_path):
    def factory():
        import os
        import uuid

        (tmp_path / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return lambda prompts: [p.upper() for p in prompts]

    df = spark.createDataFrame([(i, f"p{i}" if i else None) for i in range(400)], "example_id bigint, text string").repartition(24)
    rows = S.batch_predict(df, factory).collect()
    assert all(r["prediction"] == (r["text"] or "").upper() for r in rows)
    loads = Counter(p.name.split("-")[0] for p in tmp_path.iterdir())
    assert set(loads.values()) == {1}


def test_report_identities(spark):
    from conftest import SF_SMALL
    from toolcorpus.plans.queries import q_metrics_report

    for r in q_metrics_report(spark, SF_SMALL).collect():
        assert 0 <= max(r["hallucination_rate"], r["exact_tool_match_rate"]) <= r["valid_json_rate"] <= 100

"""Call cascades and JSON validity, on inputs of our own: nested, tagged, trailing text, two calls, Unicode, stray brackets."""

import json

import pytest
from pyspark.sql import functions as F

from toolcorpus.functions.braces import tagged_object, top_level_spans
from toolcorpus.functions.calls import extract_call_text, parse_call, parsed_call
from toolcorpus.functions.jsonx import is_json, json_string, py_json
from toolcorpus.operators.extract import extraction_status, to_results

BOOK = '{"name": "book_ferry", "arguments": {"port": "Malmö", "deck": 2}}'


def column(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["x"] for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def parsed(spark, texts, profile):
    return [json.loads(x) if x is not None else None for x in column(spark, texts, lambda c: parse_call(c, profile))]


def test_profiles_on_plain_tagged_embedded_and_missing_calls(spark):
    texts = [BOOK, f"<functioncall>{BOOK}</s>", f"Boarding now: {BOOK} thanks", "no ferry today", "", None]
    call = json.loads(BOOK)
    assert parsed(spark, texts, "pairs") == [call, call, call, None, None, None]
    assert parsed(spark, texts, "metrics") == [call, call, call, None, None, None]
    assert parsed(spark, texts, "inference") == [call, call, call, None, None, None]


def test_first_of_two_calls_wins_and_a_broken_match_moves_to_the_next_pattern(spark):
    other = BOOK.replace("book_ferry", "cancel_ferry")
    assert column(spark, [BOOK + " " + other], lambda c: parsed_call(c, "pairs").getField("name")) == ["book_ferry"]
    broken = '<functioncall> {"name": oops} then {"name": "late"}'
    assert parsed(spark, [broken], "pairs") == [None]
    assert parsed(spark, ['<functioncall> {oops} then ' + BOOK], "pairs") == [json.loads(BOOK)]


def test_objects_inside_arguments_need_the_whole_text(spark):
    deep = '{"name": "plan", "arguments": {"legs": {"a": {"b": [1, 2]}}, "n": 1}}'
    assert parsed(spark, [deep], "pairs") == [None]
    assert parsed(spark, ["  " + deep + "\n"], "metrics") == [json.loads(deep)]
    assert parsed(spark, ["[1, 2]", '"name"', '{"title": 1}'], "metrics") == [None, None, None]


def test_raw_call_text_and_status(spark):
    texts = ['Ok <functioncall> {"name": "ping", "arguments": {}} </s>', "sorry", BOOK]
    assert column(spark, texts, extract_call_text) == ['{"name": "ping", "arguments": {}', None, BOOK]
    assert column(spark, texts, extraction_status) == ["extracted_not_json", "no_call_found", "valid_call"]


def test_results_rows(spark):
    df = spark.createDataFrame([(f"so {BOOK}", 7.7777), ("nothing here", 0.04)], "raw_output string, latency_ms double")
    got = {r["valid"]: r for r in to_results(df).collect()}
    assert got[True]["function_name"] == "book_ferry" and got[True]["latency_ms"] == 7.8
    assert got[True]["arguments"] == json.dumps({"port": "Malmö", "deck": 2})
    assert got[False]["function_name"] is None and got[False]["arguments"] == "{}" and got[False]["latency_ms"] == 0.0


@pytest.mark.filterwarnings("ignore")
def test_validity_agrees_with_python_on_stray_brackets(spark):
    texts = ['{"a":1}', '{"a":1}]', '{"a":1} ] junk', '{"a":1}}', '{"a":1},', '{"a":1}],', '{"a":1}]}', "[1]", "[1]]", '"x"', "x", "1", "",
             "{'a': 1}", '{"a": [1, {"b": "]}"}]}', '{"a":1} ] {"b": 2}', '{"name": "f", "arguments": {"a": 1}, "z": 2} ] {"b": {"c": 1}}', "null"]

    def python(t):
        try:
            json.loads(t)
        except ValueError:
            return False
        return True

    assert column(spark, texts, is_json) == [python(t) for t in texts]


def test_rendering_escapes_like_python(spark):
    values = ["é", "naïve — 𝄞", "plain", 'q"\\', "tab\t"]
    assert column(spark, values, json_string) == [json.dumps(v) for v in values]
    docs = ['{"k":[1,2.5,null],"ü":{"s":"a: b, c"}}', "[]"]
    assert column(spark, docs, py_json) == [json.dumps(json.loads(d)) for d in docs]


def nested(levels):
    text = "1"
    for k in range(levels):
        text = f'{{"k{k}": {text}}}'
    return text


def test_brace_scans_have_no_depth_limit():
    for levels in (1, 2, 9, 12, 400):
        text = nested(levels)
        assert [("x " + text + " y")[a:b] for a, b in top_level_spans("x " + text + " y")] == [text]
        assert tagged_object("go <functioncall>  " + text + " end", "<functioncall>") == text
    assert top_level_spans("no braces") == [] and top_level_spans("{ open") == []
    assert [s for s in top_level_spans("} {a} {b}")] == []
    assert tagged_object('<functioncall> {"q": "a } b \\" {"} rest', "<functioncall>") == '{"q": "a } b \\" {"}'
    assert tagged_object("<functioncall> none <functioncall> {}", "<functioncall>") == "{}"
    assert tagged_object("<functioncall> {", "<functioncall>") is None

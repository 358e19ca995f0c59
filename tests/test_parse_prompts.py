"""Corpus parsing, splitting and prompt rendering."""

import json
import math

from pyspark.sql import functions as F

from toolcorpus.operators import parse as B
from toolcorpus.operators import prompts as PR

SCHEMA = {"name": "get_weather", "description": "Get weather for a city", "parameters": {
    "type": "object", "properties": {"location": {"type": "string"}}, "required": ["location"]}}


def raw(spark, rows):
    return spark.createDataFrame(rows, "example_id bigint, system string, chat string")


def test_parse_turns_markers(spark):
    df = raw(spark, [(1, "", "junk USER: hi\nASSISTANT: yo </s>\nFUNCTION RESPONSE: {}")])
    turns = B.parse_corpus(df).first()["turns"]
    assert [(t.role, t.content) for t in turns] == [("user", "hi"), ("assistant", "yo"), ("tool", "{}")]


def test_schemas_and_calls(spark):
    system = "SYSTEM: use these -\n" + json.dumps(SCHEMA, indent=4) + "\n{\"name\": \"no_description\"}"
    call = {"name": "get_weather", "arguments": {"location": "Lahore"}}
    chat = f"USER: weather?\nASSISTANT: <functioncall> {json.dumps(call)} </s>\nFUNCTION RESPONSE: {{\"t\": 20}}"
    bal = B.parse_corpus(raw(spark, [(1, system, chat)])).first()
    assert bal["function_names"] == ["get_weather"] and json.loads(bal["functions"][0]) == SCHEMA
    assert [json.loads(c) for c in bal["function_calls"]] == [call] and bal["has_function_call"]
    lazy = B.parse_corpus(raw(spark, [(1, system, chat)]), "lazy").first()
    assert lazy["function_calls"] == [] and not lazy["has_function_call"]


def test_split_exact_sizes_and_hash_stability(spark):
    df = spark.range(0, 997).withColumnRenamed("id", "example_id")
    out = B.split_corpus(df, 0.05, 42, "exact")
    assert out.where("split = 'validation'").count() == math.ceil(997 * 0.05)
    h1 = {r.example_id for r in B.split_corpus(df, 0.05, 42, "hash").where("split='validation'").collect()}
    h2 = {r.example_id for r in B.split_corpus(df.repartition(5), 0.05, 42, "hash").where("split='validation'").collect()}
    assert h1 == h2


def test_system_prompt(spark):
    df = spark.createDataFrame([([json.dumps(SCHEMA)],), ([],)], "f array<string>")
    rows = df.select(PR.system_prompt(F.col("f"), "compact").alias("c"),
                     PR.system_prompt(F.col("f"), "pretty").alias("p")).collect()
    assert rows[1]["c"] == rows[1]["p"] == "You are a helpful assistant."
    assert "get_weather" in rows[0]["c"] and "JSON" in rows[0]["c"]
    assert rows[0]["p"] == PR.SYSTEM_PREFIX + json.dumps([SCHEMA], indent=2) + PR.CALL_INSTRUCTION
    assert rows[0]["c"] == PR.SYSTEM_PREFIX + json.dumps([SCHEMA]) + PR.CALL_INSTRUCTION


def test_tool_role_and_chatml(spark):
    turns = [("user", "What time is it?"), ("tool", '{"time": "12:00"}'), ("assistant", "It is noon.")]
    df = spark.createDataFrame([([],)], "f array<string>").withColumn(
        "turns", F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in turns]))
    text = df.select(PR.training_text(F.col("f"), F.col("turns")).alias("x")).first()["x"]
    assert text.count("<|im_start|>") == 4 and text.count("<|im_end|>") == 4
    assert '<|im_start|>user\n[FUNCTION RESPONSE]: {"time": "12:00"}<|im_end|>' in text
    assert text.endswith("<|im_end|>\n")
    ev = df.select(PR.eval_prompt(F.col("f"), F.col("turns")).alias("x")).first()["x"]
    assert "It is noon." not in ev
    pp = df.select(PR.pair_prompt(F.col("f"), F.slice("turns", 1, 1)).alias("x")).first()["x"]
    assert pp == ""


def test_pack_sequences_joins_and_cuts(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1))) for i in range(50)]
    df = spark.createDataFrame(rows, "example_id bigint, text string")
    out = sorted(PR.pack_sequences(df.repartition(5), 10).collect(), key=lambda r: r["example_id"])
    start = 0
    for r in out:
        assert r["bin_id"] * 10 + r["offset"] == start and r["n_tokens"] == r["example_id"] % 7 + 1
        start += r["n_tokens"]
    assert len(out) == 50 and start == sum(i % 7 + 1 for i in range(50))
    one = {r["example_id"]: r for r in PR.pack_sequences(df.limit(49), 10).collect()}
    assert len([r for r in out if r["example_id"] in one and one[r["example_id"]] == r]) == 49


def test_deep_schemas_calls_and_braces_in_strings(spark):
    deep = 1
    for k in range(12):
        deep = {f"k{k}": deep}
    schema = {"name": "deep", "description": "d } {", "parameters": deep}
    call = {"name": "deep", "arguments": {"q": "a } b {", "o": deep}}
    system = "use these\n"
    chat = "USER: go\nASSISTANT: <functioncall> " + json.dumps(call) + " </s>"
    plain = {"name": "deep", "description": "d", "parameters": deep}
    row = B.parse_corpus(raw(spark, [(1, system + json.dumps(plain), chat), (2, json.dumps(schema), chat)])).collect()
    assert json.loads(row[0]["functions"][0]) == plain
    assert all([json.loads(c) for c in r["function_calls"]] == [call] for r in row)


def test_exact_split_of_keys_that_repeat_has_the_exact_share(spark):
    df = spark.range(0, 100).select((F.col("id") % 10).alias("example_id"))
    assert B.split_corpus(df, 0.05, 42, "exact").where("split = 'validation'").count() == 5


def test_capped_text_keeps_its_white_space_and_null_lists_have_a_prompt(spark):
    df = spark.createDataFrame([(" a\n\nb\tc d", ["x"]), ("a b", None)], "t string, f array<string>")
    assert [r["t"] for r in PR.cap_length(df, "t", 3).collect()] == [" a\n\nb\tc", "a b"]
    null = df.where("f is null").select(*[PR.system_prompt(F.col("f"), m).alias(m) for m in ("pretty", "compact")]).first()
    assert set(null) == {PR.NO_FUNCTIONS_PROMPT}

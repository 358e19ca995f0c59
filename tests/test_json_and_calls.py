import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from toolcorpus.functions import calls as C
from toolcorpus.functions.jsonx import is_json, names_of, py_json, py_json_list
from toolcorpus.functions.text import py_strip
from toolcorpus.operators import pairs as E
from toolcorpus.operators import prompts as PR
from toolcorpus.operators import scoring as S
from toolcorpus.operators.extract import to_results
from toolcorpus.operators.parse import parse_turns

LONG = "x\\\"é" * 250_000  # a megabyte with escapes
CALL = json.dumps({"name": "f", "arguments": {"a": LONG, "b": [1, LONG], "c": True}})


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").repartition(3)
    return [r["x"] for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def plain(text):
    try:
        return json.dumps(json.loads(text))
    except (ValueError, TypeError, RecursionError):
        return None


def random_json(rng, depth=3):
    kind = rng.randrange(9 if depth else 6)
    if kind < 6:
        return [lambda: rng.randrange(-10 ** 20, 10 ** 20), lambda: rng.uniform(-1e30, 1e30), lambda: rng.choice([True, False, None]),
                lambda: "".join(rng.choice('ab"\\é☃\n{}[]:,😀\u2028') for _ in range(rng.randrange(8))), lambda: 1.0, lambda: ""][kind]()
    if kind < 7:
        return [random_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["name", "arguments", "k", "", "é"]): random_json(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_decoder_equals_python_on_generated_broken_and_long_texts(spark):
    rng = random.Random(4)
    texts = [json.dumps(random_json(rng), ensure_ascii=rng.random() < 0.5) for _ in range(400)]
    texts += [t[:rng.randrange(len(t) + 1)] + rng.choice(["", "}", "]", ",", " x", "\x00", "'"]) + t[rng.randrange(len(t) + 1):] for t in texts]
    texts += ['{"a": 1, "b": 2, "a": {"a": 3, "a": 4}}', "NaN", "[Infinity, -Infinity]", "1.50", "1e400", "-0", "01", "", " ", None, '"\\ud800"', "'a'",
              "[1,]", '{"a":}', "nul", '\ufeff{"a": 1}', "[" * 200_000, CALL, '{"k": "' + "y" * 1_000_000 + '"}', "[1] ]", '"\t"']
    assert column(spark, texts, py_json) == [plain(t) for t in texts]
    assert column(spark, texts, is_json) == [plain(t) is not None or t is not None and t.startswith("[") and _valid(t) for t in texts]


def _valid(t):
    try:
        json.loads(t)
    except (ValueError, RecursionError):
        return False
    return True


def test_lists_of_schemas(spark):
    rows = [['{"name": "a"}', "no", '{"name": 5}', "[1]", '{"x":1, "name": "last", "name": "é"}'], [], None]
    assert column(spark, rows, names_of, "array<string>") == [["a", "", "5", "", "é"], [], None]
    assert column(spark, rows, py_json_list, "array<string>") == [
        json.dumps([json.loads(t) for t in rows[0] if t != "no"]), "[]", None]


def cascade(text, profile):
    """The patterns as written, one search each."""
    for p in C.PROFILES[profile]:
        found = text.strip() if p == C.WHOLE else (m.group(1) if (m := re.search(p, text, re.DOTALL)) else None)
        try:
            value = json.loads(found) if found is not None else None
        except ValueError:
            continue
        if found is not None and (p != C.WHOLE or isinstance(value, dict) and "name" in value):
            return found
    return None


def test_scanner_equals_the_cascades_on_generated_texts():
    rng = random.Random(7)
    bits = ["<functioncall>", "{", "}", '{"name": "f"', '{"name":\n"g", "arguments": {', '"name"', "}}", "} }", ", ", '"a": 1', " ", "\n", "text", '"', "[1]",
            '{"name": "f", "arguments": {"a": 1}}', '{"name": "f", "arguments": {"a": {"b": 1}}}', "\x1c", "</s>", '{"foo": 1}']
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        for profile in C.PROFILES:
            assert C.scan(text, profile)[0] == cascade(text, profile), (text, profile)
        for pattern, find in C.FINDERS.items():
            m = re.search(pattern, text, re.DOTALL)
            assert find(text) == (m.group(1) if m else None), (text, pattern)


@pytest.mark.parametrize("piece", ["<functioncall>{", '{"name": "f", "arguments": {', "{", "}", '{"name": "', "<functioncall> ", "} ", '{ "name" ', " "])
def test_scanner_is_linear_on_texts_without_an_end(piece):
    text = piece * (2_000_000 // len(piece))
    began = time.perf_counter()
    for profile in C.PROFILES:
        C.scan(text, profile)
    assert time.perf_counter() - began < 10


def test_long_values_pass_through_every_consumer(spark):
    call, args = json.loads(CALL), json.loads(CALL)["arguments"]
    df = spark.createDataFrame([(1, "p", CALL, ["f", "g"], CALL, 1.0)], "example_id long, prompt string, completion string, available_functions array<string>, raw_output string, latency_ms double")
    got = to_results(df).first()
    assert got["function_name"] == "f" and json.loads(got["arguments"]) == args and got["arguments"] == json.dumps(args)
    for strategy, want in (("wrong_function", {"name": "g", "arguments": args}),
                           ("wrong_params", {"name": "f", "arguments": {"a": LONG[::-1], "b": [LONG, 1], "c": -43}})):
        assert E.build_pairs(df, strategy=strategy).first()["rejected"] == json.dumps(want)
    left = json.loads(E.build_pairs(df, strategy="missing_params").first()["rejected"])["arguments"]
    assert len(left) == 1 and all(args[k] == v for k, v in left.items())
    corpus = spark.createDataFrame([(1, [CALL], [("user", "hi")], [CALL])],
                                   "example_id long, functions array<string>, turns array<struct<role:string,content:string>>, function_calls array<string>")
    assert E.pair_examples(corpus).first()["completion"] == CALL
    assert corpus.select(S.reference_call(F.col("function_calls"))).first()[0] == CALL
    assert corpus.select(PR.system_prompt(F.col("functions"), "compact")).first()[0] == PR.SYSTEM_PREFIX + json.dumps([call]) + PR.CALL_INSTRUCTION


def test_strip_and_cap_pass_long_runs_once(spark):
    blanks = "a" + " \t\n" * 350_000 + "b"
    began = time.perf_counter()
    assert column(spark, [" " + blanks + "\x1f\u2003", " \n", ""], py_strip) == [blanks, "", ""]
    turns = column(spark, ["USER: " + blanks + " ASSISTANT:" + blanks + " </s>"], parse_turns)[0]
    assert [(t["role"], t["content"]) for t in turns] == [("user", blanks), ("assistant", blanks)]
    assert time.perf_counter() - began < 30
    text = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, text)], "example_id long, text string")
    for n in (64, 2048, 20_000):
        got = PR.cap_length(df, "text", n).first()
        assert got["text"] == " ".join(text.split()[:n]) and got["n_tokens"] == 30_000 and got["truncated"]


def test_overlap_counts_as_a_multiset_and_takes_no_time_on_long_lists(spark):
    from collections import Counter

    rng = random.Random(2)
    sides = [([rng.choice("abcde") for _ in range(rng.randrange(9))], [rng.choice("abcde") for _ in range(rng.randrange(9))]) for _ in range(200)]
    many = [f"t{i}" for i in range(8000)]
    sides += [(many, many[::-1]), ([], []), ([], ["a"])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(sides)], "i int, a array<string>, b array<string>")
    rows = df.select("i", S.multiset_overlap(F.col("a"), F.col("b")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in rows] == [sum((Counter(a) & Counter(b)).values()) for a, b in sides]


def test_scores_use_the_last_of_equal_keys_and_names_of_any_type(spark):
    rows = [(1, '{"name": "a", "name": "f", "arguments": {"x": 1, "x": "u v"}}', '{"name": "f", "arguments": {"x": "v u"}}', ["f"]),
            (2, '{"name": 5, "arguments": {}}', '{"name": "5", "arguments": {}}', ["5"]), (3, '{"name": null}', '{"name": null, "arguments": []}', []),
            (4, '{"name": "f", "arguments": {"x": [null, "a"], "y": {"k": true}}}', '{"name": "f", "arguments": {"z": [null, "a"], "w": {"k": true}}}', None)]
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, example_id int, prediction string, reference string, allowed_functions array<string>")
    got = {r["example_id"]: r for r in S.score_examples(df).collect()}
    assert (got[1]["tool_match"], got[1]["hallucinated"], got[1]["precision"], got[1]["recall"]) == (True, False, 1.0, 1.0)
    assert (got[2]["tool_match"], got[2]["hallucinated"], got[2]["precision"]) == (False, True, 1.0)
    assert got[3]["tool_match"] and not got[3]["hallucinated"] and got[4]["precision"] == 1.0

"""Preference pairs on calls of our own: what each strategy changes, when it applies, and that draws do not depend on partitions."""

import json

import pytest

from toolcorpus.operators import pairs as E

TICKET = {"name": "open_ticket", "arguments": {"queue": "network", "urgency": 3, "tags": ["vpn", "büro"], "note": None}}
TOOLS = ["open_ticket", "close_ticket", "list_queues"]
SCHEMA = "example_id bigint, prompt string, completion string, available_functions array<string>"


def built(spark, calls, tools=TOOLS, **options):
    rows = [(i, f"p{i}", c if isinstance(c, str) else json.dumps(c), tools) for i, c in enumerate(calls)]
    return {r["example_id"]: r for r in E.build_pairs(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_another_available_name_with_the_same_arguments(spark):
    row = built(spark, [TICKET], strategy="wrong_function")[0]
    got = json.loads(row["rejected"])
    assert got["name"] in {"close_ticket", "list_queues"} and got["arguments"] == TICKET["arguments"]
    assert "b\\u00fcro" in row["rejected"] and row["rejection_strategy"] == "wrong_function"
    assert built(spark, [TICKET], tools=["open_ticket"], strategy="wrong_function") == {}


def test_every_value_is_corrupted_by_its_type(spark):
    arguments = {"object": {"a": 1}, "long": "harbour", "short": "abc", "int": -8, "big": 10**20, "float": 0.123456789012, "huge": 1e20, "whole": 1.0, "yes": True,
                 "no": False, "list": [1.0, 2, "é", None, [3]], "none": [], "null": None, "last": "ok"}
    got = built(spark, [{"name": "n", "arguments": arguments}], strategy="wrong_params")[0]["rejected"]
    want = {"object": "invalid_value", "long": "ruobrah", "short": "invalid_value", "int": -50, "big": -(10**20 + 42), "float": -42.123456789012, "huge": -1e20,
            "whole": -43.0, "yes": -43, "no": -42, "list": [[3], None, "é", 2, 1.0], "none": "invalid_value",
            "null": "invalid_value", "last": "invalid_value"}
    assert got == json.dumps({"name": "n", "arguments": want})
    assert built(spark, [{"name": "n", "arguments": {}}], strategy="wrong_params") == {}


def test_half_of_the_parameters_stay(spark):
    got = json.loads(built(spark, [TICKET], strategy="missing_params")[0]["rejected"])["arguments"]
    assert len(got) == 2 and all(TICKET["arguments"][k] == v for k, v in got.items())
    assert built(spark, [{"name": "n", "arguments": {"one": 1}}], strategy="missing_params") == {}


def test_invented_function_always_applies(spark):
    got = json.loads(built(spark, ['{"name": "n"}'], strategy="hallucinate")[0]["rejected"])
    assert got["name"] in E.HALLUCINATED_NAMES and got["arguments"] == {"query": "example", "target": "user"}


def test_rows_without_a_call_give_no_pair(spark):
    assert built(spark, ["plain answer", ""]) == {} and built(spark, [TICKET], strategy="no such strategy") == {}


@pytest.mark.parametrize("options", [{}, {"random_choice": True}])
def test_at_most_one_pair_each_and_strategies_vary(spark, options):
    got = built(spark, [TICKET] * 50, seed=3, **options)
    assert set(got) == set(range(50)) and len({r["rejection_strategy"] for r in got.values()}) == 4
    assert all(r["chosen"] == json.dumps(TICKET) != r["rejected"] for r in got.values())


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "p", json.dumps(TICKET), TOOLS) for i in range(40)], SCHEMA)
    one, many = (sorted(map(str, E.build_pairs(df.repartition(n)).collect())) for n in (1, 6))
    assert one == many


def test_sample_call_from_parameter_types(spark):
    from toolcorpus.sources.catalog import catalog_from_json

    props = {"where": {"type": "string"}, "mode": {"type": "string", "enum": ["fährt", "steht"]}, "limit": {"type": "number"},
             "count": {"type": "integer"}, "dry": {"type": "boolean"}, "rest": {"type": "object"}}
    schema = {"name": "track", "description": "d", "parameters": {"type": "object", "properties": props}}
    df = spark.createDataFrame([(json.dumps(schema),)], "schema_json string")
    want = {"name": "track", "arguments": {"where": "example_where", "mode": "fährt", "limit": 42.0, "count": 60, "dry": True}}
    assert E.sample_calls(catalog_from_json(df)).first()["call"] == json.dumps(want)


def test_pair_examples_split_the_chat_once(spark):
    from conftest import SF_SMALL
    from toolcorpus.plans.queries import QUERIES

    plan = QUERIES["pair_examples"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=USER:") == 1

"""Preference pairs: one rejected call per chosen call, four corruption strategies.

Randomness is ``stable_hash(seed, salt, example_id, ...)`` (see functions.rand):
same distribution as a sequential generator, but independent of row order and
partitioning, so the operator is one narrow projection with no shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from toolcorpus.functions.calls import call_fields, scan
from toolcorpus.functions.jsonx import encoded, json_string, py_json, utf8
from toolcorpus.functions.rand import stable_hash
from toolcorpus.functions.rows import keep_where
from toolcorpus.operators.parse import function_names

# --- fixed values (must equal the original for identical outputs) -------------
STRATEGIES = ("wrong_function", "wrong_params", "missing_params", "hallucinate")
HALLUCINATED_NAMES = (
    "send_email", "play_music", "control_device", "access_database",
    "delete_file", "call_contact", "print_document", "take_screenshot",
)
HALLUCINATED_ARGUMENTS = '{"query": "example", "target": "user"}'
INVALID_VALUE = "invalid_value"
PARAM_OFFSET = 42
# ------------------------------------------------------------------------------


def _draw(seed, salt, key, *more) -> Column:
    return stable_hash(seed, salt, key, *more)


def corrupted(value):
    """E4 per value, first match wins: a string of more than three characters or a list with elements is reversed, a
    number (true and false are 1 and 0) is moved beyond zero by the offset, all else is replaced."""
    if isinstance(value, (int, float)):
        return -(abs(value) + PARAM_OFFSET)
    if isinstance(value, str) and len(value) > 3 or isinstance(value, list) and value:
        return value[::-1]
    return INVALID_VALUE


_PARTS_TYPE = "struct<name:string,name_json:string,has_name:boolean,arguments:string,args:array<struct<k:string,key:string,value:string,bad:string>>>"
_PARTS_ARROW = pa.struct([("name", pa.string()), ("name_json", pa.string()), ("has_name", pa.bool_()), ("arguments", pa.string()),
                          ("args", pa.list_(pa.struct([(n, pa.string()) for n in ("k", "key", "value", "bad")])))])


def call_parts(completion: Column) -> Column:
    """The call of a completion, decoded once: its name, its arguments as JSON, and, if they are an object, each key
    with its value and its corrupted value as JSON. Null where there is no call."""
    def parts(text):
        found, call = scan(text, "pairs")
        if found is None:
            return None
        fields = call_fields(found, call)
        args = call.get("arguments")
        args = [{"k": utf8(k), "key": encoded(k), "value": encoded(v), "bad": encoded(corrupted(v))}
                for k, v in args.items()] if isinstance(args, dict) else None
        return {n: fields[n] for n in ("name", "name_json", "has_name", "arguments")} | {"args": args}

    @F.arrow_udf(_PARTS_TYPE)
    def run(completions: pa.Array) -> pa.Array:
        return pa.array([parts(t) for t in completions.to_pylist()], _PARTS_ARROW)

    return run(completion)


def _object_json(args: Column, field: str) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(args, lambda a: F.concat(a["key"], F.lit(": "), a[field])), ", "), F.lit("}"))


def _call_json(name_json: Column, args_json: Column) -> Column:
    return F.concat(F.lit('{"name": '), name_json, F.lit(', "arguments": '), args_json, F.lit("}"))


def strategy_candidates(df: DataFrame, seed: int = 42, key: str = "example_id",
                        completion: str = "completion", available: str = "available_functions") -> tuple[DataFrame, dict[str, Column]]:
    """The rows with a call and an ``_ok_<strategy>`` flag each, and the rejection of each strategy, not yet computed."""
    k = F.col(key)
    out = keep_where(df.withColumn("_call", call_parts(F.col(completion))), F.col("_call").isNotNull())
    name, args = F.col("_call.name"), F.col("_call.args")
    avail = F.coalesce(F.col(available), F.array().cast("array<string>"))
    out = out.withColumn("_alts", F.filter(avail, lambda f: ~f.eqNullSafe(F.when(F.col("_call.has_name"), name))))

    # E3 wrong_function: another available name, arguments kept as they are.
    alts = F.col("_alts")
    pick = F.element_at(alts, (_draw(seed, "wrong_function", k) % F.greatest(F.size(alts), F.lit(1)) + 1).cast("int"))
    wf_ok = F.size(alts) > 0
    wf = _call_json(json_string(pick), F.col("_call.arguments"))

    # E4 wrong_params: corrupt every value, keep name and key order.
    obj_ok = F.col("_call.has_name") & args.isNotNull()
    wp_ok = obj_ok & (F.size(args) > 0)
    wp = _call_json(F.col("_call.name_json"), _object_json(args, "bad"))

    # E5 missing_params: shuffle keys, keep max(1, n // 2), in shuffled order.
    mp_ok = obj_ok & (F.size(args) >= 2)
    shuffled = F.transform(F.array_sort(F.transform(args, lambda a: F.struct(
        _draw(seed, "missing_params", k, a["k"]).alias("h"), a["k"].alias("k"), a.alias("a")))), lambda s: s["a"])
    kept = F.slice(shuffled, 1, F.greatest(F.lit(1), F.floor(F.size(args) / 2).cast("int")))
    mp = _call_json(F.col("_call.name_json"), _object_json(kept, "value"))

    # E6 hallucinate: one of the fixed names, constant arguments, always applicable.
    names = F.array(*[F.lit(n) for n in HALLUCINATED_NAMES])
    hal_name = F.element_at(names, (_draw(seed, "hallucinate", k) % len(HALLUCINATED_NAMES) + 1).cast("int"))
    hal = _call_json(json_string(hal_name), F.lit(HALLUCINATED_ARGUMENTS))

    cand = {"wrong_function": (wf_ok, wf), "wrong_params": (wp_ok, wp),
            "missing_params": (mp_ok, mp), "hallucinate": (F.lit(True), hal)}
    for s, (ok, _) in cand.items():
        out = out.withColumn(f"_ok_{s}", F.coalesce(ok, F.lit(False)))
    return out, {s: rej for s, (_, rej) in cand.items()}


def build_pairs(df: DataFrame, seed: int = 42, strategy: str | None = None, key: str = "example_id",
                completion: str = "completion", available: str = "available_functions",
                prompt: str = "prompt", random_choice: bool = False) -> DataFrame:
    """(example_id, prompt, chosen, rejected, rejection_strategy), at most one pair per row.

    Default (E8): strategies tried in a per-example random order, the first
    applicable one wins. ``strategy`` (E9) forces one strategy; ``random_choice``
    draws one strategy per example. Forced/drawn strategies that do not apply
    yield no row.
    """
    cand, rejections = strategy_candidates(df, seed, key, completion, available)
    k = F.col(key)
    if strategy is not None:
        if strategy not in STRATEGIES:
            return cand.where(F.lit(False)).select(key, F.col(prompt).alias("prompt"),
                                                   F.col(completion).alias("chosen"),
                                                   F.lit(None).cast("string").alias("rejected"),
                                                   F.lit(strategy).alias("rejection_strategy"))
        chosen_s = F.lit(strategy)
    elif random_choice:
        chosen_s = F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]),
                                (_draw(seed, "choice", k) % len(STRATEGIES) + 1).cast("int"))
    else:
        order = F.array_sort(F.array(*[F.struct(_draw(seed, "order", k, s).alias("h"), F.lit(s).alias("s"))
                                       for s in STRATEGIES]))
        applicable = F.filter(order, lambda o: F.element_at(
            F.map_from_arrays(F.array(*[F.lit(s) for s in STRATEGIES]),
                              F.array(*[F.col(f"_ok_{s}") for s in STRATEGIES])), o["s"]))
        chosen_s = F.try_element_at(applicable, F.lit(1)).getField("s")
    # The strategy is chosen first, so only its rejection is built.
    cand = cand.withColumn("_chosen", chosen_s)
    chosen_s, rejected = F.col("_chosen"), F.lit(None).cast("string")
    for s in STRATEGIES:
        rejected = F.when((chosen_s == s) & F.col(f"_ok_{s}"), rejections[s]).otherwise(rejected)
    out = cand.select(key, F.col(prompt).alias("prompt"), F.col(completion).alias("chosen"),
                      rejected.alias("rejected"), chosen_s.alias("rejection_strategy"))
    return keep_where(out, F.col("rejected").isNotNull())


def pair_examples(corpus: DataFrame, prompt_fn=None) -> DataFrame:
    """Rows with calls -> (example_id, prompt, completion, available_functions).

    prompt = all turns but the last rendered as a training prompt (``""`` for
    one-turn dialogues); completion = the first call re-serialised like
    ``json.dumps``; available = the schema names.
    """
    from toolcorpus.operators.prompts import pair_prompt

    prompt_fn = prompt_fn or pair_prompt
    rows = keep_where(corpus, F.size("function_calls") > 0)
    return rows.select(
        "example_id",
        prompt_fn(F.col("functions"), F.col("turns")).alias("prompt"),
        py_json(F.element_at("function_calls", 1)).alias("completion"),
        function_names(F.col("functions")).alias("available_functions"),
    )


def sample_calls(catalog: DataFrame) -> DataFrame:
    """One correct call per schema from its parameter types.

    string -> first enum value or ``example_<param>``; number -> 42.0;
    integer -> 60; boolean -> true; other types are skipped. One narrow
    projection over the parsed schema rows (no explode/regroup).
    """
    props = F.map_entries(F.col("parameters.properties"))

    def value(e):
        typ = F.coalesce(e["value"]["type"], F.lit("string"))
        first_enum = F.try_element_at(e["value"]["enum"], F.lit(1))
        return (F.when(typ == "string", json_string(F.coalesce(first_enum, F.concat(F.lit("example_"), e["key"]))))
                .when(typ == "number", F.lit("42.0")).when(typ == "integer", F.lit("60"))
                .when(typ == "boolean", F.lit("true")))

    pairs = F.filter(F.transform(props, lambda e: F.struct(e["key"].alias("k"), value(e).alias("v"))),
                     lambda x: x["v"].isNotNull())
    args = F.concat(F.lit("{"), F.array_join(F.transform(
        pairs, lambda x: F.concat(json_string(x["k"]), F.lit(": "), x["v"])), ", "), F.lit("}"))
    return catalog.select(F.col("name").alias("function"),
                          _call_json(json_string(F.col("name")), args).alias("call"))

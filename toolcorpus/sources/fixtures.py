"""Deterministic corpus inputs rendered from the driver's tables.

The driver's ``conversations`` and ``events`` tables hold no tool calls, so the
inputs of every operator are rendered from them with plain Spark expressions
(the oracle SQL renders the same text independently):

* tool catalogue  - one tool per distinct ``event_type`` (sorted), fixed parameters;
* call JSON       - per event, arguments from ``user_id``/``props.k``/``event_id``;
* raw dialogues   - one row per conversation, role-marked ``system``/``chat`` text
                    with tool schemas and ``<functioncall>`` turns injected;
* eval rows       - reference call + three stub model predictions per event;
* pair input      - prompt/completion/available functions per event.

Everything grows with the source tables; nothing is made up or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from toolcorpus.operators.joins import BROADCAST_MAX_BYTES, bounded_side, spread
from toolcorpus.plans.stages import materialize

DEFAULT_SYSTEM = "You are a helpful assistant with access to the following functions. Use them if required -"
TOOLS_PER_DIALOGUE = 3
MODELS = ("base", "sft_lora", "dpo")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c):
    return c.cast("string")


def tool_dimension(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, DataFrame]:
    """(tools, n_tools, windows); the tools, one row per distinct event type, are written once per call.

    Both are marked for broadcast if they are small: a fact joined to them by
    shuffle would be in one task per tool.
    """
    return _tool_sides(spark, sf_dir)[:3]


def _tool_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, DataFrame, bool]:
    """The ``tool_dimension``, and whether both sides are marked for broadcast."""
    tools = materialize(tool_catalog(spark, sf_dir), "tools")
    found = tools.agg(F.count("*").alias("n"), F.sum(F.octet_length("name") + F.octet_length("schema_json") + 64).alias("bytes")).first()
    n_tools, size = found["n"], found["bytes"] or 0
    window_size = TOOLS_PER_DIALOGUE * size
    tools = bounded_side(tools, size)
    return tools, n_tools, bounded_side(tool_windows(tools, n_tools), window_size), window_size <= BROADCAST_MAX_BYTES


def tool_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tool_idx, name, schema_json): one tool per distinct event type, sorted by name."""
    names = _read(spark, sf_dir, "events").select(F.col("event_type").alias("name")) \
        .where(F.col("name").isNotNull()).distinct()
    # The distinct set is a dimension (one row per event type); numbering it
    # in one ordered window is cheap after the partial-aggregated distinct.
    tools = names.withColumn("tool_idx", (F.row_number().over(Window.orderBy("name")) - 1).cast("bigint"))
    schema = F.concat(
        F.lit('{"name": "'), F.col("name"), F.lit('", "description": "Record a '), F.col("name"),
        F.lit(' event", "parameters": {"type": "object", "properties": {'
              '"user": {"type": "string", "description": "User handle"}, '
              '"k": {"type": "integer", "description": "Event key"}, '
              '"urgent": {"type": "boolean"}, '
              '"tags": {"type": "array", "items": {"type": "string"}}}, '
              '"required": ["user", "k"]}}'),
    )
    return tools.select("tool_idx", "name", schema.alias("schema_json"))


def _args_json(event_id, user_id, k):
    full = F.concat(
        F.lit('{"user": "user_'), _s(user_id), F.lit('", "k": '), k,
        F.lit(', "urgent": '), F.when(event_id % 2 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit(', "tags": ["t'), _s(event_id % 3), F.lit('", "x"]}'),
    )
    one = F.concat(F.lit('{"user": "user_'), _s(user_id), F.lit('"}'))
    return F.when(event_id % 5 == 4, F.lit("{}")).when(event_id % 5 == 3, one).otherwise(full)


def _call(name, args):
    return F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": '), args, F.lit("}"))


def call_events(spark: SparkSession, sf_dir: str, tools: DataFrame, windows: DataFrame, broadcast: bool = False) -> DataFrame:
    """Events with their tool index, call JSON and allowed functions, dealt evenly to tasks.

    A file may be one split, read and dealt by one task: where both sides are
    ``broadcast``, it deals the narrow rows and the joins follow in the tasks
    that got them. Joins by shuffle would gather rows again; these are dealt after.
    """
    events = _read(spark, sf_dir, "events")
    n = events.count()  # for Parquet a count of the footers
    ev = events.select("event_id", "user_id", F.col("event_type").alias("name"), "value", "props")
    if broadcast:
        ev = spread(ev, n)
    ev = _allowed(ev.join(tools.select("name", "tool_idx"), "name"), windows)
    if not broadcast:
        ev = spread(ev, n)
    ev = ev.withColumn("k", F.get_json_object("props", "$.k")).drop("props")
    return ev.withColumn("call_json", _call(F.col("name"), _args_json(F.col("event_id"), F.col("user_id"), F.col("k"))))


def tool_windows(tools: DataFrame, n_tools: int) -> DataFrame:
    """(residue, tool_names, schemas): the tools offered for residue r = (r + i) mod n, i < 3.

    A dimension of ``n_tools`` rows computed from the tool dimension alone, so
    facts reach it with an equi-join on ``key mod n`` instead of a regroup.
    """
    m = min(TOOLS_PER_DIALOGUE, n_tools)
    picks = tools.select(F.col("tool_idx").alias("residue"),
                         F.posexplode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i", "off"))
    picks = picks.withColumn("tool_idx", (F.col("residue") + F.col("off")) % F.lit(n_tools))
    picks = picks.join(tools, "tool_idx")
    win = picks.groupBy("residue").agg(F.array_sort(F.collect_list(F.struct("i", "name", "schema_json"))).alias("w"))
    return win.select("residue", F.transform("w", lambda x: x["name"]).alias("tool_names"),
                      F.transform("w", lambda x: x["schema_json"]).alias("schemas"))


def raw_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, system, chat) rendered from ``conversations`` (+ tools, + calls)."""
    tools, n_tools, windows = tool_dimension(spark, sf_dir)
    conv = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # Only some assistant turns may hold a call: they alone are joined, to narrow event columns, and rendered after.
    may = F.coalesce((F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 3 == 1), F.lit(False))
    events = _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_event"), "user_id", F.col("event_type").alias("call_name"), F.get_json_object("props", "$.k").alias("k"))
    events = events.join(tools.select(F.col("name").alias("call_name")), "call_name")
    narrow = conv.where(may).withColumn("call_event", F.col("conv_id") * 10 + F.col("turn")).join(events, "call_event", "left")
    call = F.when(F.col("conv_id") % 2 == 0, _call(F.col("call_name"), F.lit('"none"'))).otherwise(
        _call(F.col("call_name"), _args_json(F.col("call_event"), F.col("user_id"), F.col("k"))))
    conv = narrow.select(*conv.columns, F.when(F.col("call_name").isNotNull(), call).alias("inj_call")).unionByName(
        conv.where(~may).withColumn("inj_call", F.lit(None).cast("string")))
    injected, inj_call = F.col("inj_call").isNotNull(), F.col("inj_call")
    line = (
        F.when(F.col("role") == "user", F.concat(F.lit("USER: "), F.col("text")))
        .when(injected, F.concat(F.lit("ASSISTANT: <functioncall> "), inj_call,
                                 F.lit(' </s>\nFUNCTION RESPONSE: {"ok": true}')))
        .when(F.col("role") == "assistant", F.concat(F.lit("ASSISTANT: "), F.col("text"), F.lit(" </s>")))
        .when(F.col("role") == "system", F.col("text"))
    )
    part = F.when(F.col("role") == "system", F.lit(0)).otherwise(F.lit(1))
    turn_lines = conv.select("conv_id", part.alias("part"), F.col("turn").alias("ord"), line.alias("line")) \
        .where(F.col("line").isNotNull())
    grouped = turn_lines.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "ord", "line"))).alias("lines"))

    def joined(p):
        return F.array_join(F.transform(F.filter("lines", lambda x: x["part"] == p), lambda x: x["line"]), "\n")

    grouped = grouped.withColumn("residue", F.col("conv_id") % F.lit(n_tools))
    grouped = grouped.join(windows.select("residue", "schemas"), "residue")
    system = F.concat(
        F.lit("SYSTEM: "), F.coalesce(F.nullif(joined(0), F.lit("")), F.lit(DEFAULT_SYSTEM)),
        F.lit("\n"), F.array_join("schemas", "\n"))
    return grouped.select(F.col("conv_id").alias("example_id"), system.alias("system"), joined(1).alias("chat"))


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, example_id, prediction, reference, allowed_functions, latency_ms) per event x model."""
    tools, _, windows, broadcast = _tool_sides(spark, sf_dir)
    ev = call_events(spark, sf_dir, tools, windows, broadcast)
    e, uid, k, name = F.col("event_id"), _s(F.col("user_id")), F.col("k"), F.col("name")
    bucket = e % 10
    prose = F.concat(F.lit("I could not find a tool for request "), _s(e), F.lit("."))
    unknown = F.concat(F.lit('<functioncall> {"name": "lookup_'), name, F.lit('", "arguments": {"user": "user_'),
                       uid, F.lit('"}} </s>'))
    nested = F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": {"k": '), _s(k.cast("bigint") + 1),
                      F.lit(', "user": {"id": '), uid, F.lit("}}}"))
    shifted = _call(name, F.concat(F.lit('{"user": "user_'), _s(F.col("user_id") + 1), F.lit('", "k": '),
                                   _s(k.cast("bigint") + 1), F.lit("}")))
    flipped = F.concat(F.lit("Sure! "), _call(name, F.concat(
        F.lit('{"user": "user_'), uid, F.lit('", "urgent": '),
        F.when(e % 2 == 0, F.lit("false")).otherwise(F.lit("true")), F.lit("}"))), F.lit(" Done."))
    exact = F.col("call_json")
    tagged_exact = F.concat(F.lit("<functioncall> "), exact, F.lit(" </s>"))
    preds = {
        "base": F.when(bucket <= 5, prose).when(bucket <= 7, unknown).when(bucket == 8, nested).otherwise(exact),
        "sft_lora": F.when(bucket == 0, prose).when(bucket == 1, unknown).when(bucket <= 3, shifted)
                     .otherwise(tagged_exact),
        "dpo": F.when(bucket == 0, prose).when(bucket == 1, flipped).otherwise(exact),
    }
    per_model = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("prediction")) for m, p in preds.items()])
    out = ev.select("event_id", "call_json", "allowed_functions", "value",
                    F.explode(per_model).alias("mp"), "name", "k", "user_id")
    return out.select(F.col("mp.model").alias("model"), F.col("event_id").alias("example_id"),
                      F.col("mp.prediction").alias("prediction"), F.col("call_json").alias("reference"),
                      "allowed_functions", F.col("value").alias("latency_ms"))


def _allowed(ev: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds ``allowed_functions``: own tool first, then the next tools (mod n)."""
    win = windows.select(F.col("residue").alias("tool_idx"),
                                              F.col("tool_names").alias("allowed_functions"))
    return ev.join(win, "tool_idx")


def pair_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, prompt, completion, available_functions) per event."""
    tools, _, windows, broadcast = _tool_sides(spark, sf_dir)
    ev = call_events(spark, sf_dir, tools, windows, broadcast)
    e = F.col("event_id")
    completion = F.when(e % 11 == 0, F.concat(F.lit("No tool is needed for request "), _s(e), F.lit(".")))\
        .otherwise(F.col("call_json"))
    available = F.when(e % 7 == 0, F.array(F.col("name"))).otherwise(F.col("allowed_functions"))
    return ev.select(e.alias("example_id"), F.concat(F.lit("Request "), _s(e)).alias("prompt"),
                     completion.alias("completion"), available.alias("available_functions"))

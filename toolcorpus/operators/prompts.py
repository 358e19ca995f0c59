"""Prompt rendering: system prompt, messages, ChatML text, eval/pair/inference prompts."""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from toolcorpus.functions.jsonx import py_json_list
from toolcorpus.functions.text import py_split
from toolcorpus.functions.tokens import Tokenizer, first_tokens, token_count
from toolcorpus.operators.scan import prefix_scan, row_numbers
from toolcorpus.plans.stages import materialize

# --- fixed values (literal texts of the original prompts) ---------------------
NO_FUNCTIONS_PROMPT = "You are a helpful assistant."
SYSTEM_PREFIX = "You are a helpful assistant that calls functions when appropriate.\nAvailable functions:\n\n"
CALL_INSTRUCTION = (
    "\nWhen calling a function respond ONLY with valid JSON in this exact format:\n"
    '{"name": "<function_name>", "arguments": {<key>: <value>, ...}}\n'
    "Do not include any explanation or extra text."
)
TOOL_PREFIX = "[FUNCTION RESPONSE]: "
IM_START, IM_END = "<|im_start|>", "<|im_end|>"
# ------------------------------------------------------------------------------

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


@lru_cache(maxsize=4096)
def _pretty(schemas: tuple[str, ...]) -> str:
    return json.dumps([json.loads(x) for x in schemas], indent=2)


@F.pandas_udf(T.StringType())
def pretty_functions(functions: pd.Series) -> pd.Series:
    """``json.dumps(list_of_schemas, indent=2)``; lists repeat across dialogues and are rendered once per worker."""
    return pd.Series([None if arr is None else _pretty(tuple(arr)) for arr in functions])


def system_prompt(functions: Column, mode: str = "pretty") -> Column:
    """C1. ``compact``: schemas as ``json.dumps(functions)``; ``pretty`` (default): with ``indent=2``."""
    if mode == "compact":
        body = py_json_list(functions)
    elif mode == "pretty":
        body = pretty_functions(functions)
    else:
        raise ValueError(f"unknown system prompt mode {mode!r}")
    full = F.concat(F.lit(SYSTEM_PREFIX), body, F.lit(CALL_INSTRUCTION))
    return F.when(F.coalesce(F.size(functions), F.lit(0)) <= 0, F.lit(NO_FUNCTIONS_PROMPT)).otherwise(full)


def with_system_prompt(df: DataFrame, mode: str = "pretty", out: str = "system_prompt",
                       functions: str = "functions") -> DataFrame:
    """Adds the system prompt column; no shuffle in either mode, null lists give the prompt without functions."""
    return df.withColumn(out, system_prompt(F.col(functions), mode))


def to_messages(system: Column, turns: Column) -> Column:
    """System message first; tool -> user with the response prefix; only user/assistant/system kept."""
    mapped = F.transform(turns, lambda t: F.when(
        t["role"] == "tool",
        F.struct(F.lit("user").alias("role"), F.concat(F.lit(TOOL_PREFIX), t["content"]).alias("content")),
    ).otherwise(F.struct(t["role"].alias("role"), t["content"].alias("content"))))
    kept = F.filter(mapped, lambda m: m["role"].isin("user", "assistant", "system"))
    head = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))
    return F.concat(head, F.coalesce(kept, F.array().cast(MESSAGE_TYPE)))


def render_chatml(messages: Column) -> Column:
    """``<|im_start|>role\\ncontent<|im_end|>`` per message, newline-joined, trailing newline."""
    blocks = F.transform(messages, lambda m: F.concat(F.lit(IM_START), m["role"], F.lit("\n"), m["content"],
                                                      F.lit(IM_END)))
    return F.concat(F.array_join(blocks, "\n"), F.lit("\n"))


def training_text(functions: Column, turns: Column, mode: str = "pretty") -> Column:
    """C4: ChatML over the system prompt and every turn."""
    return render_chatml(to_messages(system_prompt(functions, mode), turns))


def sft_text(corpus: DataFrame, mode: str = "pretty") -> DataFrame:
    return corpus.withColumn("text", training_text(F.col("functions"), F.col("turns"), mode))


def eval_prompt(functions: Column, turns: Column, mode: str = "pretty") -> Column:
    """Every assistant turn removed (tool turns stay), then C4."""
    return training_text(functions, F.filter(turns, lambda t: t["role"] != "assistant"), mode)


def pair_prompt(functions: Column, turns: Column, mode: str = "pretty") -> Column:
    """All turns but the last, then C4; ``""`` when there is at most one turn."""
    n = F.size(turns)
    return F.when(n > 1, training_text(functions, F.slice(turns, F.lit(1), n - 1), mode)).otherwise(F.lit(""))


def inference_prompt(user_message: Column, functions: Column, mode: str = "pretty") -> Column:
    """System + user blocks and an open assistant header."""
    return F.concat(F.lit(IM_START + "system\n"), system_prompt(functions, mode), F.lit(IM_END + "\n"),
                    F.lit(IM_START + "user\n"), user_message, F.lit(IM_END + "\n"),
                    F.lit(IM_START + "assistant\n"))


def preview_prompt(user_message: Column, functions: Column, mode: str = "pretty") -> Column:
    """System, user, a closed empty assistant block, then an open assistant header."""
    return F.concat(F.lit(IM_START + "system\n"), system_prompt(functions, mode), F.lit(IM_END + "\n"),
                    F.lit(IM_START + "user\n"), user_message, F.lit(IM_END + "\n"),
                    F.lit(IM_START + "assistant\n" + IM_END + "\n"), F.lit(IM_START + "assistant\n"))


def _n_tokens(text: Column, tokenizer: Tokenizer | None) -> Column:
    return (F.size(py_split(text)) if tokenizer is None else token_count(text, tokenizer)).cast("bigint")


def cap_length(df: DataFrame, col: str, max_tokens: int, out: str | None = None, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Keep the first ``max_tokens`` tokens of ``col``; adds ``n_tokens`` and ``truncated``.

    Tokens are runs without white space, or those of ``tokenizer``
    (``functions.tokens``). The kept text is the text up to the end of the last
    kept token, its own white space and all.
    """
    out = out or col
    if tokenizer is None:
        # Possessive throughout: no state is kept for each of the tokens.
        ws = r"[\s\x{1c}-\x{1f}]"
        kept = F.regexp_extract(F.col(col), rf"(?sU)^(?:{ws}*+[^\s\x{{1c}}-\x{{1f}}]++){{{int(max_tokens)}}}+", 0)
    else:
        kept = first_tokens(F.col(col), int(max_tokens), tokenizer)
    return df.withColumn("n_tokens", _n_tokens(F.col(col), tokenizer)) \
             .withColumn("truncated", F.col("n_tokens") > max_tokens) \
             .withColumn(out, F.when(F.col("truncated"), kept).otherwise(F.col(col)))


def pack_sequences(df: DataFrame, max_tokens: int, key: str = "example_id", text: str = "text",
                   tokenizer: Tokenizer | None = None) -> DataFrame:
    """Texts joined end to end in the order of ``key`` and cut into bins of ``max_tokens`` tokens.

    Output: (bin_id, example_id, offset, n_tokens); a text starts in ``bin_id`` at
    ``offset`` and runs over into the next bins. Where it starts is the sum of
    the tokens before it, a running total over the whole table without a task
    that sees all of it (``operators.scan``); the layout is the same for any
    partitions. Keys should differ; rows with equal keys come in any order.
    """
    lens = df.select(F.col(key), F.coalesce(_n_tokens(F.col(text), tokenizer), F.lit(0)).alias("n_tokens"))
    placed = prefix_scan(materialize(lens, "pack-lengths"), [key], "n_tokens", "__start", tie=F.monotonically_increasing_id())
    return placed.select(F.floor(F.col("__start") / max_tokens).cast("bigint").alias("bin_id"), key,
                         (F.col("__start") % max_tokens).alias("offset"), "n_tokens")


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, for ``counts`` rows of each length: ``(length, from, to, first_bin, per_bin, offset)``.

    Rows number ``from`` to ``to - 1`` of a length go ``per_bin`` to a bin, from ``first_bin`` on,
    the first of a bin at ``offset``. Bins that are filled alike are held as one
    range under their free space, so the work grows with the number of
    different lengths, not with the rows.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> ranges (first bin, bins)
    spaces: list[int] = []  # the free spaces there are, in order
    out, bins = [], 0

    def add(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces.pop(at)
            else:
                space, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            per = space // length  # the tightest bin stays the tightest until the length no longer fits
            placed = min(left, n * per)
            out.append((length, done, done + placed, first, per, capacity - space))
            full, rest = divmod(placed, per)
            add(space - per * length, first, full)
            if rest:
                add(space - rest * length, first + full, 1)
            untouched = full + bool(rest)
            add(space, first + untouched, n - untouched)
            done, left = done + placed, left - placed
    return out


def pack_whole(df: DataFrame, max_tokens: int, key: str = "example_id", text: str = "text",
               tokenizer: Tokenizer | None = None) -> DataFrame:
    """Rows packed whole into bins of ``max_tokens`` tokens: (bin_id, example_id, offset, n_tokens, truncated).

    Best fit with the longest rows first, so at most 11/9 of the fewest bins
    possible (and one). A row longer than a bin counts as ``max_tokens``, to
    which ``cap_length`` cuts it, and is ``truncated``. A row without tokens
    takes no room: bin 0, offset 0. The layout depends on keys and
    lengths alone; rows with equal keys and lengths come in any order.

    The plan is made from the number of rows of each length, ``max_tokens``
    numbers at most whatever the size of the table. A row's place follows from
    its number among the rows of its length, by ``operators.scan``.
    """
    lens = df.select(F.col(key), F.coalesce(_n_tokens(F.col(text), tokenizer), F.lit(0)).alias("__n"))
    lens = materialize(lens.select(key, F.least("__n", F.lit(max_tokens)).cast("bigint").alias("n_tokens"),
                                   (F.col("__n") > max_tokens).alias("truncated")), "pack-lengths")
    counts = {r["n_tokens"]: r["count"] for r in lens.groupBy("n_tokens").count().collect()}  # at most max_tokens + 1 rows
    plan: dict[int, list[tuple]] = {}
    for length, *piece in packing_plan({k: n for k, n in counts.items() if k}, max_tokens):
        plan.setdefault(length, []).append(tuple(piece))
    before, starts = 0, {}
    for length in sorted(counts):
        starts[length], before = before, before + counts[length]
    kind = "n_tokens bigint, __first bigint, __plan array<struct<a:bigint,b:bigint,bin:bigint,per:bigint,at:bigint>>"
    pieces = df.sparkSession.createDataFrame([(k, starts[k], plan.get(k, [(0, counts[k], 0, counts[k], 0)])) for k in counts], kind)
    placed = row_numbers(lens, ["n_tokens", key], "__i", tie=F.monotonically_increasing_id()).join(F.broadcast(pieces), "n_tokens")
    placed = placed.withColumn("__i", F.col("__i") - F.col("__first"))
    mine = F.get(F.filter("__plan", lambda p: (p["a"] <= F.col("__i")) & (F.col("__i") < p["b"])), F.lit(0))
    placed = placed.withColumn("__p", mine).withColumn("__j", F.col("__i") - F.col("__p.a"))
    return placed.select((F.col("__p.bin") + F.floor(F.col("__j") / F.col("__p.per"))).cast("bigint").alias("bin_id"), key,
                         (F.col("__p.at") + F.col("__j") % F.col("__p.per") * F.col("n_tokens")).alias("offset"), "n_tokens", "truncated")

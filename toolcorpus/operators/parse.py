"""Corpus parsing, filtering and splitting (raw dialogues -> typed corpus)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from toolcorpus.functions.braces import found_objects, objects_with, tagged_object
from toolcorpus.functions.calls import tagged
from toolcorpus.functions.jsonx import names_of
from toolcorpus.functions.permute import permuted
from toolcorpus.functions.rand import HASH_RANGE, stable_hash
from toolcorpus.functions.rows import keep_where
from toolcorpus.functions.text import py_strip, remove_suffix
from toolcorpus.operators.scan import row_numbers
from toolcorpus.plans.stages import materialize

# --- fixed values: role markers and their roles -------------------------------
MARKERS = (("USER:", "user"), ("ASSISTANT:", "assistant"), ("FUNCTION RESPONSE:", "tool"))
END_OF_TURN = "</s>"
CALL_TAG = "<functioncall>"
# ------------------------------------------------------------------------------

TURN_TYPE = "array<struct<role:string,content:string>>"


def extract_schemas(system: Column) -> Column:
    """B1: top-level ``{...}`` objects of the system text, of any depth, that decode with ``name`` and ``description``."""
    return objects_with(system, "name", "description")


def function_names(functions: Column) -> Column:
    """``name`` of each schema, ``""`` when missing."""
    return names_of(functions)


def parse_turns(chat: Column) -> Column:
    """B2: split before every role marker, strip, map to (role, content); text before the first marker is dropped."""
    lookahead = "(?=" + "|".join(m for m, _ in MARKERS) + ")"
    parts = F.filter(F.transform(F.split(py_strip(chat), lookahead), py_strip), lambda p: p != F.lit(""))

    def to_turn(p):
        out = None
        for marker, role in MARKERS:
            body = p.substr(F.lit(len(marker) + 1), F.length(p))
            content = py_strip(remove_suffix(py_strip(body), END_OF_TURN))
            turn = F.struct(F.lit(role).alias("role"), content.alias("content"))
            out = F.when(p.startswith(marker), turn) if out is None else out.when(p.startswith(marker), turn)
        return out

    turns = F.filter(F.transform(parts, to_turn), lambda t: t.isNotNull())
    return F.coalesce(turns, F.array().cast(TURN_TYPE))


def extract_calls(turns: Column, mode: str = "balanced") -> Column:
    """First ``<functioncall>`` object per assistant turn, kept when it decodes.

    ``balanced`` takes the whole brace-balanced object, braces in strings not
    counting (the intent of the original extractor); ``lazy`` stops at the first ``}`` like its regex, so
    calls whose arguments are objects fail to decode and are dropped.
    """
    assistant = F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["content"])
    return found_objects(assistant, (lambda t: tagged_object(t, CALL_TAG)) if mode == "balanced" else tagged)


def read_dialogues_columns(df: DataFrame) -> DataFrame:
    """A1 semantics: a missing ``system``/``chat`` becomes ``""``."""
    return df.withColumn("system", F.coalesce(F.col("system"), F.lit(""))) \
             .withColumn("chat", F.coalesce(F.col("chat"), F.lit("")))


def parse_corpus(raw: DataFrame, call_mode: str = "balanced", calls_only: bool = False) -> DataFrame:
    """One projection from (example_id, system, chat) to the typed corpus.

    With ``calls_only`` the cheap ``chat LIKE '%<functioncall>%'`` pre-filter
    (implied by ``has_function_call``) runs before any parsing.
    """
    raw = read_dialogues_columns(raw)
    if calls_only:
        raw = raw.where(F.col("chat").contains(CALL_TAG))
    parsed = raw.select(
        "example_id",
        extract_schemas(F.col("system")).alias("functions"),
        parse_turns(F.col("chat")).alias("turns"),
    )
    parsed = parsed.select(
        "example_id", "functions", function_names(F.col("functions")).alias("function_names"),
        "turns", extract_calls(F.col("turns"), call_mode).alias("function_calls"),
    )
    parsed = parsed.withColumn("num_turns", F.size("turns")) \
                   .withColumn("has_function_call", F.size("function_calls") > 0)
    if calls_only:
        parsed = keep_with_calls(parsed)
    return parsed


def keep_with_calls(corpus: DataFrame) -> DataFrame:
    """Rows with at least one call (flag evaluated once, never re-inlined into a pushed filter)."""
    return keep_where(corpus, F.col("has_function_call"))


def explode_turns(corpus: DataFrame) -> DataFrame:
    """B2x: long form (example_id, turn_idx, role, content)."""
    return corpus.select("example_id", F.posexplode("turns").alias("turn_idx", "t")) \
        .select("example_id", F.col("turn_idx").cast("bigint"), F.col("t.role").alias("role"),
                F.col("t.content").alias("content"))


def head(df: DataFrame, n: int | None, key: str = "example_id") -> DataFrame:
    """A2/F2: first ``n`` rows by ``key`` (top-k); ``None``/0 means no cap."""
    if not n:
        return df
    return df.orderBy(key).limit(n)


def split_draw(seed: int = 42, key: str = "example_id") -> Column:
    """Draw used by both split modes: uniform in [0, 2^32), depends on (seed, key) only."""
    return stable_hash(seed, "split", F.col(key))


def split_corpus(df: DataFrame, ratio: float = 0.05, seed: int = 42, mode: str = "hash",
                 key: str = "example_id") -> DataFrame:
    """Add ``split`` in {train, validation}.

    ``hash``: validation when ``h/2^32 < ratio`` - no shuffle, stable when rows are appended.
    ``exact``: exactly ``ceil(n * ratio)`` validation rows. Rows are numbered in the
    order of ``key`` (``operators.scan``, one shuffle by range), and a seeded
    permutation of the numbers deals them out: row ``i`` is validation if
    ``perm(i) < ceil(n * ratio)``. Which rows are chosen depends on the keys and the seed
    alone; rows with equal or null keys are numbered in any order. The rows are
    written once before they are numbered, so a parse does not run again.
    """
    if mode == "hash":
        cut = (split_draw(seed, key).cast("double") / float(HASH_RANGE)) < F.lit(float(ratio))
        return df.withColumn("split", F.when(cut, "validation").otherwise("train"))
    if mode != "exact":
        raise ValueError(f"unknown split mode {mode!r}")
    rows = row_numbers(materialize(df, "split-rows"), [key], "__i", tie=F.monotonically_increasing_id())
    n = rows.count()
    chosen = permuted(F.col("__i"), n, seed) < math.ceil(n * ratio)
    return rows.withColumn("split", F.when(chosen, "validation").otherwise("train")).drop("__i")

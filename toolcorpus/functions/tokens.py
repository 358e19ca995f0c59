"""Token counts and caps by a public tokenizer's vocabulary file.

The file's path is a parameter and must be readable where the tasks run (a
shared folder, or one that ``SparkContext.addFile`` ships); nothing is trained
and nothing is copied. Each Python worker loads it once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary file: ``.json`` (tokenizers), ``.tiktoken`` (ranks, with the split ``pattern``) or ``.model`` (sentencepiece)."""

    path: str
    pattern: str = r"\s?\p{L}+|\s?\p{N}+|\s?[^\s\p{L}\p{N}]+|\s+"


def _whole(spans: list[tuple[int, int]]) -> list[int]:
    """Ends of tokens from their ``(begin, end)``; one that shares a character with the next token ends before it."""
    begins = [a for a, _ in spans[1:]] + [spans[-1][1]] if spans else []
    return [min(b, after) for (_, b), after in zip(spans, begins, strict=True)]


@lru_cache(maxsize=4)
def ends_of(tokenizer: Tokenizer):
    """A function from a text to where each of its tokens ends, in code points. Special tokens in a text are ordinary text."""
    path = tokenizer.path
    if path.endswith(".json"):
        from tokenizers import Tokenizer as Loaded

        loaded = Loaded.from_file(path)
        loaded.encode_special_tokens = True
        return lambda text: _whole(loaded.encode(text, add_special_tokens=False).offsets)
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("own", pat_str=tokenizer.pattern, mergeable_ranks=ranks, special_tokens={})

        def spans(text: str) -> list[tuple[int, int]]:
            out, at = [], 0
            for piece in coder.decode_tokens_bytes(coder.encode_ordinary(text)):
                begun = sum(b & 0xC0 != 0x80 for b in piece)
                out.append((at - (piece[0] & 0xC0 == 0x80), at + begun))
                at += begun
            return out

        return lambda text: _whole(spans(text))
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)

        def places(text: str) -> list[int]:
            begun = [0]  # characters begun before each byte
            for b in text.encode():
                begun.append(begun[-1] + (b & 0xC0 != 0x80))
            return _whole([(begun[p.begin], begun[p.end]) for p in pieces.encode(text, return_type="proto").pieces])

        return places
    raise ValueError(f"unknown kind of tokenizer file: {path}")


def token_count(text: Column, tokenizer: Tokenizer) -> Column:
    """Number of tokens; null for a null text."""
    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        ends = ends_of(tokenizer)
        return pd.Series([None if t is None else len(ends(t)) for t in texts], dtype="Int64")

    return run(text)


def first_tokens(text: Column, n: int, tokenizer: Tokenizer) -> Column:
    """The text up to the end of its first ``n`` tokens; a character that they share with the next token is left out."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        ends = ends_of(tokenizer)

        def cut(t: str) -> str:
            at = ends(t)
            return t if len(at) <= n else t[:at[n - 1] if n else 0]

        return pd.Series([None if t is None else cut(t) for t in texts])

    return run(text)

"""Spelling variant grouping by reduced-alphabet generation."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from toolcorpus.llm.common import materialize

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
# Symbols that letters are reduced to.
SYMBOLS = 8
# Words counted at once in a task, bytes of a text split at once, and hashes of neighbourhoods held at once.
HELD_WORDS, CHUNK, HELD_HASHES = 1 << 18, 1 << 20, 1 << 20

# One byte for each letter: a-z, and U+00C0 to U+00FF as in Latin-1; A-Z lower-cased, a blank for all else.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 192 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def runs(text: str) -> Iterator[list[bytes]]:
    """Maximal runs of letters, a byte each, of a whole text, split a bounded piece at a time."""
    raw, at = text.encode("latin-1", "replace").translate(_LETTERS), 0
    while at < len(raw):
        to = raw.find(b" ", at + CHUNK)
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


def respelled(run: bytes, key: int, drop_every: int) -> bytes:
    """The run without its letter ``h % length`` where ``drop_every`` divides ``h``, the crc32 of its UTF-8 that goes on from ``key``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), key)
    if h % drop_every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count(batches: Iterator[pa.RecordBatch], min_chars: int, drop_every: int | None) -> Iterator[pa.RecordBatch]:
    def held() -> pa.RecordBatch:
        words = {w.decode("latin-1"): n for w, n in counts.items() if len(w) >= min_chars}
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    counts: dict[bytes, int] = {}
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if not text:
                continue
            start = zlib.crc32(f"{'' if key is None else key}:".encode())
            own = Counter()
            for piece in runs(text):
                own.update(piece)
            for run, n in own.items():
                if len(run) >= min_chars:
                    word = run if drop_every is None else respelled(run, start, drop_every)
                    counts[word] = counts.get(word, 0) + n
            if len(counts) > HELD_WORDS:
                yield held()
                counts = {}
    yield held()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, drop_every: int | None = None) -> DataFrame:
    """``(word, n)``: words of ``min_chars`` code points that occur ``min_count`` times in all texts together.

    A word is a maximal run of ``A-Z``, ``a-z`` and U+00C0 to U+00FF, with A-Z
    lower-cased. With ``drop_every``, a run loses its code point ``h % length``
    where that number divides ``h``, the crc32 of ``<identifier>:<run>`` (a
    null identifier is empty text there): misspellings to be found again.
    Null and empty texts have no words; very long texts are split piece by
    piece; repeated rows count each; an empty table gives no rows; other
    columns are ignored. Words are counted in the tasks before they are
    shuffled, so a frequent word sends one row per task.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    parts = rows.mapInArrow(lambda b: _count(b, min_chars, drop_every), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def symbols(points: np.ndarray, kinds: int) -> np.ndarray:
    """The symbol, 1 to ``kinds``, that each code point is reduced to by a hash."""
    x = points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(40)) % np.uint64(kinds)) + np.uint64(1)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(positions in the list, code points as a matrix)`` for the words of each length, in bounded pieces."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        every = np.flatnonzero(sizes == size)
        step = max(1, HELD_HASHES // max(1, 32 * int(size)))
        for k in range(0, len(every), step):
            at = every[k:k + step]
            flat = "".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass")
            yield at, np.frombuffer(flat, np.uint32).reshape(len(at), int(size))


def powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])


def reduced_key(s: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each reduced word, a row of symbols."""
    return (s * powers(s.shape[1])[:s.shape[1]]).sum(1, dtype=np.uint64)


def neighbourhood(s: np.ndarray, kinds: int) -> Iterator[np.ndarray]:
    """Hashes of the reduced words themselves and of all that one deletion, replacement or insertion makes of them.

    With the sums of the hash before and from each place, an edit there is one
    addition: what follows moves by one power of the base. Each array has a
    row per word; places go in bounded pieces.
    """
    n, size = s.shape
    p = powers(size + 1)
    terms = s * p[:size]
    upto = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, 1, dtype=np.uint64)], 1)
    after = upto[:, -1:] - upto
    yield upto[:, -1:]
    step = max(1, HELD_HASHES // max(1, n * kinds))
    x = np.arange(1, kinds + 1, dtype=np.uint64)
    for a in range(0, size + 1, step):
        b, c = min(a + step, size), min(a + step, size + 1)
        if a < b:
            yield upto[:, a:b] + after[:, a + 1:b + 1] * _BACK
            yield ((upto[:, a:b] + after[:, a + 1:b + 1])[:, :, None] + (p[a:b, None] * x)[None]).reshape(n, -1)
        yield ((upto[:, a:c] + after[:, a:c] * _BASE)[:, :, None] + (p[a:c, None] * x)[None]).reshape(n, -1)


def _with_key(batches: Iterator[pa.RecordBatch], kinds: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, keys = batch.column("word").to_pylist(), np.zeros(batch.num_rows, np.uint64)
        for at, points in by_length(words):
            keys[at] = reduced_key(symbols(points, kinds))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], [*batch.schema.names, "key"])


def _neighbours(batches: Iterator[pa.RecordBatch], kinds: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        for _, points in by_length(words):
            s = symbols(points, kinds)
            own = reduced_key(s)
            for near in neighbourhood(s, kinds):
                near = np.sort(near, axis=1)
                new = np.ones(near.shape, bool)
                new[:, 1:] = near[:, 1:] != near[:, :-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.broadcast_to(own[:, None], near.shape)[new].view(np.int64)), pa.array(near[new].view(np.int64))],
                    ["key", "near"])


def near_words(words: DataFrame, kinds: int = SYMBOLS) -> DataFrame:
    """``(word, n, near, near_n)``: every ordered pair of the distinct words ``(word, n)`` one edit apart.

    Letters are hashed to ``kinds`` symbols. One edit of a word is one edit, or
    none, of its reduced word, so the full one-edit neighbourhood of each
    distinct reduced word, joined to the distinct reduced words, holds every
    pair; the original strings decide. Neither words nor reduced words are
    paired within a group: only reduced words that are neighbours meet.
    """
    vocabulary = materialize(words.select("word", "n").mapInArrow(lambda b: _with_key(b, kinds), "word string, n bigint, key bigint"),
                             "spelling-words")
    reduced = materialize(vocabulary.groupBy("key").agg(F.min("word").alias("word")), "spelling-reduced")
    hood = reduced.select("word").mapInArrow(lambda b: _neighbours(b, kinds), "key bigint, near bigint")
    links = materialize(hood.join(reduced.select(F.col("key").alias("near")), "near").distinct(), "spelling-links")
    a = vocabulary.join(links, "key").select("word", "n", F.col("near").alias("k"))
    b = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("key").alias("k"))
    one_edit = (F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    return a.join(b, (a["k"] == b["k"]) & one_edit).select("word", "n", "near", "near_n")


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: the last word on the way from form to form, by pointer doubling.

    Forms must not go in a circle. Each round doubles the way that is known,
    and is written to the shared folder.
    """
    step = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(max_rounds):
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(step.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if not step.where("moved").limit(1).count():
            return step.select("word", "root")
    raise RuntimeError("forms go in a circle")


def spelling_groups(words: DataFrame, kinds: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of ``(word, n)``.

    Two words are near if one inserted, deleted or replaced code point makes
    one of the other. A word's form is its near word of the largest ``n`` (ties:
    the smallest in code-point order) if that is ``ratio`` times its own ``n``
    at least, else null. ``root`` follows the forms to the last; it is the word
    itself if it has none. Rows that repeat a word are added up first; a null
    word or count is passed over; an empty table gives no rows.
    """
    words = materialize(words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("bigint").alias("n")),
                        "spelling-counts")
    best = near_words(words, kinds).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("near"))).alias("best"))
    large = -F.col("best.neg") >= ratio * F.col("n")
    out = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.neg")).alias("form_n")), "spelling-forms")
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

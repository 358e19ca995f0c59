"""Benchmark decontamination: CGK embedding of item-sized windows, bit-sampling LSH, then exact edit distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from toolcorpus.llm.common import materialize, packed

# Words that may differ, as a share of an item's words.
MAX_EDITS = 0.2
# Bytes of items that one pass over the documents takes.
BLOCK_BYTES = 4 << 20
VOCABULARY = 1 << 18
# Windows embedded at once.
HELD_WINDOWS = 1 << 13
LENGTHS = 64
# Independent random walks, and the share of items at exactly the limit that all tables together may miss.
WALKS, MISS = 8, 1e-3
# Pairs of strings on which the agreement of a length is measured, and the most tables of a walk.
TRIALS, MOST_TABLES = 64, 40
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_M = np.uint64(0x9E3779B97F4A7C15)


def plain(token: str) -> str:
    """A word without case and without marks around it; empty if it has no letter or digit."""
    token = token.lower().strip(MARKS)
    if token.isalnum():
        return token
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


class Words(dict):
    """Token to the 64-bit hash of its plain word, 0 for none; starts afresh when ``VOCABULARY`` is reached."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.digest = xxhash.xxh3_64_intdigest

    def __missing__(self, token: str) -> int:
        word = plain(token)
        value = self[token] = (self.digest(word.encode()) | 1) if word else 0
        return value

    def of(self, text: str) -> np.ndarray:
        if len(self) > VOCABULARY:
            self.clear()
        tokens = text.split()
        out = np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
        return out[out != 0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of single words (1) or of neighbours (2)."""
    return words if size == 1 else _mixed(words[:-1] * _M + words[1:])


def _seeds(n: int) -> np.ndarray:
    """A hash seed for every walk and step of strings of ``n`` words."""
    ids = np.arange(WALKS * 2 * n, dtype=np.uint64).reshape(WALKS, 2 * n) + np.uint64(n << 32)
    return _mixed(_mixed(ids * _M + np.uint64(1)))


def walked(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int, steps: int) -> Iterator[np.ndarray]:
    """The CGK embedding of the strings ``flat[begin:end]``, a step at a time: ``(walks, strings)`` symbols, 0 past the end.

    Every step writes the word that the walk stands on, and goes on to the next
    one if a random bit of that word and step says so. Two walks over strings
    that differ by few edits fall into step again, so an edit distance becomes
    a Hamming distance. ``2 n`` steps cross a string of ``n`` words.
    """
    at, seeds = np.broadcast_to(begin, (WALKS, len(begin))).copy(), _seeds(n)
    for j in range(steps):
        symbols = np.where(at < end, flat[np.minimum(at, len(flat) - 1)], np.uint64(0))
        yield symbols
        at += (_mixed((symbols ^ seeds[:, j, None]) * _M) >> np.uint64(63)).astype(np.int64)


@dataclass(frozen=True)
class Tables:
    """LSH tables for one length: ``steps[walk, table, symbol]`` are the sampled steps of the embedding."""

    steps: np.ndarray

    def keys(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
        """``(walks, tables, strings)`` hashes of the sampled symbols, 0 where the string ended before one of them."""
        walks, tables, width = self.steps.shape
        got = np.zeros((walks, tables, width, len(begin)), np.uint64)
        for j, symbols in enumerate(walked(flat, begin, end, n, int(self.steps.max()) + 1)):
            w, t, k = np.nonzero(self.steps == j)
            got[w, t, k] = symbols[w]
        out = np.broadcast_to(np.arange(walks * tables, dtype=np.uint64).reshape(walks, tables, 1) + np.uint64(1), got.shape[:2] + got.shape[3:])
        for k in range(width):
            out = _mixed(out * _M + got[:, :, k])
        return np.where((got != 0).all(2), out | np.uint64(1), np.uint64(0))


@lru_cache(maxsize=4096)
def tables_for(n: int, most: int) -> Tables:
    """Tables for items of ``n`` words that find one within ``most`` edits but for a share of ``MISS``.

    The agreement of the embeddings at exactly ``most`` mixed edits is measured
    on seeded random strings. Walks are independent, so what all miss is the
    product of what each misses; tables of two symbols are taken unless they
    would need to be more than ten a walk, else tables of one.
    """
    rng = np.random.default_rng(n)
    first, second = [], []
    for _ in range(TRIALS):
        item = rng.integers(1, 1 << 62, n, dtype=np.uint64)
        other = item.tolist()
        for place in sorted(rng.choice(n, most, replace=False).tolist(), reverse=True) if most else []:
            kind = rng.integers(3)
            other[place:place + (kind != 1)] = [] if kind == 2 else [int(rng.integers(1, 1 << 62))]
        first.append(item)
        second.append(np.array(other, np.uint64))
    spans = []
    for group in (first, second):
        ends = np.cumsum([len(x) for x in group])
        spans.append((np.concatenate(group), ends - [len(x) for x in group], ends))
    same, inside = np.zeros((WALKS, TRIALS)), np.zeros((WALKS, TRIALS))
    for x, y in zip(walked(*spans[0], n, 2 * n), walked(*spans[1], n, 2 * n), strict=True):
        same += (x == y) & (x != 0)
        inside += 1
    agreement = (same / inside).ravel()
    for width, limit in ((2, 10), (1, MOST_TABLES)):
        count = next((t for t in range(1, limit + 1) if ((1 - agreement ** width) ** t).mean() ** WALKS <= MISS), None)
        if count or width == 1:
            break
    return Tables(rng.integers(0, 2 * n, (WALKS, count or MOST_TABLES, width)))


def edit_distance_within(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """Least word edits from ``item`` to any stretch of ``text`` and where that stretch ends; None if over ``most``."""
    row = np.zeros(len(text) + 1, np.int64)
    ramp = np.arange(len(text) + 1)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
        if row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= most else None


class Items:
    """One block of benchmark items: word hashes, gram sets by length and LSH tables by length."""

    def __init__(self, rows: list[tuple[object, str]], max_edits: float):
        words = Words()
        self.ids, self.words = [], []
        for key, text in rows:
            w = words.of(text)
            if len(w):
                self.ids.append(key)
                self.words.append(w)
        self.max_edits = max_edits
        self.lengths = np.array(sorted({len(w) for w in self.words}), np.int64)
        self.most = np.floor(self.lengths * max_edits + 1e-9).astype(np.int64)
        self.gram = np.where(self.lengths > 1, 2, 1)
        self.need = np.where(self.lengths > 1, self.lengths - 1 - 2 * self.most, 1)
        slot = {int(n): i for i, n in enumerate(self.lengths)}
        self.sets = {}
        for size in (1, 2):
            found: dict[int, int] = {}
            for w in self.words:
                if (2 if len(w) > 1 else 1) == size:
                    for g in grams(w, size).tolist():
                        found[g] = found.get(g, 0) | 1 << slot[len(w)]
            if found:
                keys = np.array(sorted(found), np.uint64)
                quick = np.zeros(1 << 20, bool)
                quick[(keys >> np.uint64(44)).astype(np.int64)] = True
                self.sets[size] = keys, np.array([found[k] for k in keys.tolist()], np.uint64), quick
        self.tables = {}
        for i, n in enumerate(self.lengths.tolist()):
            mine = np.array([k for k, w in enumerate(self.words) if len(w) == n])
            tables = tables_for(n, int(self.most[i]))
            flat, begin = np.concatenate([self.words[k] for k in mine]), np.arange(len(mine)) * n
            keys = tables.keys(flat, begin, begin + n, n)
            owner = np.broadcast_to(mine, keys.shape).ravel()
            keys = keys.ravel()
            order = np.argsort(keys, kind="stable")
            order = order[keys[order] != 0]
            self.tables[n] = tables, keys[order], owner[order]

    def windows(self, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(length, starts)`` of the item-sized windows that share enough grams with items of that length.

        A window within ``most`` edits of an item of ``n`` words keeps at least
        ``n - 1 - 2 * most`` of its neighbour pairs, so none is lost.
        """
        for size, (keys, masks, quick) in self.sets.items():
            if len(doc) < size:
                continue
            g = grams(doc, size)
            hit = np.flatnonzero(quick[(g >> np.uint64(44)).astype(np.int64)])
            at = np.searchsorted(keys, g[hit])
            real = keys[np.minimum(at, len(keys) - 1)] == g[hit]
            hit, at = hit[real], at[real]
            mine = np.flatnonzero(self.gram == size)
            if not len(hit) or len(hit) < self.need[mine].min():
                continue
            bits = np.unpackbits(masks[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for i in mine[bits.sum(0)[mine] >= self.need[mine]]:
                own, n, need = hit[bits[:, i] == 1], int(self.lengths[i]), int(self.need[i])
                if not (own[need - 1:] - own[:len(own) + 1 - need] <= n - size).any():
                    continue
                # A window near the text's ends may reach over them by the edits allowed.
                reach = int(self.most[i])
                total = np.zeros(len(doc) + 2 * reach + 2, np.int64)
                np.add.at(total, own + reach + 1, 1)
                total = np.cumsum(total)
                starts = np.arange(-reach, len(doc) + reach - n + 1)
                lo = starts + reach
                hi = np.minimum(lo + n - (size - 1), len(total) - 1)
                starts = starts[total[hi] - total[lo] >= need]
                if len(starts):
                    yield n, starts

    def candidates(self, flat: np.ndarray, n: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(windows, items)`` that meet in a table; ``begin`` and ``end`` bound the windows for items of ``n`` words."""
        tables, keys, owner = self.tables[n]
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = []
        for a in range(0, len(begin), HELD_WINDOWS):
            h = tables.keys(flat, begin[a:a + HELD_WINDOWS], end[a:a + HELD_WINDOWS], n)
            which = np.broadcast_to(np.arange(a, a + h.shape[2]), h.shape).ravel()
            h = h.ravel()
            lo = np.searchsorted(keys, h, "left")
            hit = np.flatnonzero((h != 0) & (keys[np.minimum(lo, len(keys) - 1)] == h))
            lo, count = lo[hit], np.searchsorted(keys, h[hit], "right") - lo[hit]
            items = owner[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
            found.append(np.unique(np.stack([np.repeat(which[hit], count), items]), axis=1))
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return both[0], both[1]

    def matches(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """``(document, item, distance, end)``: every item found in every text, at its least distance."""
        near: dict[int, list[tuple[int, np.ndarray]]] = {}
        for x, doc in enumerate(docs):
            for n, starts in self.windows(doc):
                near.setdefault(n, []).append((x, np.unique(np.clip(starts, 0, len(doc) - 1))))
        spots: dict[tuple[int, int], list[int]] = {}
        for n, places in near.items():
            # The texts that hold a window, one after another.
            flat = np.concatenate([docs[x] for x, _ in places])
            sizes = np.array([len(docs[x]) for x, _ in places])
            first = np.cumsum(sizes) - sizes
            own = np.repeat(np.arange(len(places)), [len(p) for _, p in places])
            starts = np.concatenate([p for _, p in places])
            begin = starts + first[own]
            for w, k in zip(*self.candidates(flat, n, begin, np.minimum(begin + n, (first + sizes)[own])), strict=True):
                spots.setdefault((places[own[w]][0], int(k)), []).append(int(starts[w]))
        out = []
        for (x, k), starts in sorted(spots.items()):
            item, best = self.words[k], None
            most = int(math.floor(len(item) * self.max_edits + 1e-9))
            starts = np.sort(np.array(starts))
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > len(item)) + 1):
                a, b = max(0, int(part[0]) - most), min(len(docs[x]), int(part[-1]) + len(item) + most)
                found = edit_distance_within(item, docs[x][a:b], most)
                if found and (best is None or found[0] < best[0]):
                    best = found[0], a + found[1]
                    if not found[0]:
                        break
            if best:
                out.append((x, k, *best))
        return out


def _search(batches: Iterator[pa.RecordBatch], rows: list[tuple[object, str]], max_edits: float,
            key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    items, words = Items(rows, max_edits), Words()
    for batch in batches:
        texts, out, docs, at, held = batch.column("txt"), [], [], 0, 0
        for r in range(len(texts)):
            text = texts[r].as_py()
            docs.append(words.of(text) if text else np.zeros(0, np.uint64))
            held += len(docs[-1])
            if held > 1 << 20 or r == len(texts) - 1:
                out += [(at + x, k, d, e) for x, k, d, e in items.matches(docs)] if items.words else []
                docs, at, held = [], r + 1, 0
        where = pa.array([x[0] for x in out], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(where) for c in batch.schema.names[:-1]), pa.array([items.ids[x[1]] for x in out], key_type),
             pa.array([x[2] for x in out], pa.int32()), pa.array([len(items.words[x[1]]) for x in out], pa.int32()),
             pa.array([x[3] for x in out], pa.int32())],
            [*batch.schema.names[:-1], "item_key", "distance", "item_words", "end_word"])


def _distinct_items(benchmark: DataFrame, item_text_col: str) -> DataFrame:
    """``(key, t)``: the texts of the items, each once."""
    return benchmark.where(F.col(item_text_col).isNotNull()).select(
        F.md5(F.col(item_text_col).cast("binary")).alias("key"), F.col(item_text_col).alias("t")).dropDuplicates(["key"])


def item_blocks(benchmark: DataFrame, item_text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items' texts with their keys in blocks of bounded size, each with at most ``LENGTHS`` lengths, read one by one."""
    b = _distinct_items(benchmark, item_text_col)
    total = b.select(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        part = b.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k).collect() if total else []
        by: dict[int, list] = {}
        words = Words()
        for r in sorted(part):
            by.setdefault(len(words.of(r["t"])), []).append((r["key"], r["t"]))
        lengths = sorted(n for n in by if n)
        for a in range(0, len(lengths), LENGTHS):
            yield [x for n in lengths[a:a + LENGTHS] for x in by[n]]


def _passes(benchmark: DataFrame, item_text_col: str, block_bytes: int, one) -> DataFrame | None:
    """``one(block, result so far)`` for every block; all but the last result are written, and their block is let go."""
    out, blocks = None, item_blocks(benchmark, item_text_col, block_bytes)
    block = next(blocks, None)
    while block is not None:
        out, after = one(block, out), next(blocks, None)
        if after is not None:
            out = materialize(out, "decontaminated")
        block = after
    return out


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", max_edits: float = MAX_EDITS,
                      block_bytes: int = BLOCK_BYTES, **keep) -> DataFrame | None:
    """A row per document and item found in it: the columns ``keep`` and ``item_id, distance, item_words, end_word``.

    Words are split at white space and compared without case and without marks
    around them. An item is found where a stretch of the text is within
    ``max_edits`` (share of the item's words) word insertions, deletions and
    changes; this is verified exactly. Windows of an item's size that share
    enough neighbour pairs with the items of their length (a bound that loses
    none) are embedded by random walks (``walked``) and looked up in sampled
    tables (``tables_for``), whose number follows the agreement at the limit.

    Whole texts are searched, very long ones too. Null or empty texts hold nothing; null or wordless items
    are found nowhere; equal items are each found, and repeated rows of either
    table give a row each. No documents give no rows. Other columns are ignored, whatever their names. The benchmark is a query
    set: it is read in blocks of ``block_bytes`` of different texts, and each block searches all
    documents before the next is read. None if there are no items.
    """
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text_col).alias("txt"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{fields}, item_key string, distance int, item_words int, end_word int"

    def one(block, found):
        part = rows.mapInArrow(lambda b: _search(b, block, max_edits, pa.string()), schema)
        return part if found is None else found.unionByName(part)

    out = _passes(benchmark, item_text_col, block_bytes, one)
    if out is None:
        return None
    names = benchmark.where(F.col(item_text_col).isNotNull()).select(
        F.md5(F.col(item_text_col).cast("binary")).alias("item_key"), F.col(item_col).alias("item_id"))
    return out.join(names, "item_key").select(*keep, "item_id", "distance", "item_words", "end_word")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``doc_id, item_id, distance, item_words, end_word``: see ``benchmark_matches``. Clean documents have no row."""
    found = benchmark_matches(docs, benchmark, doc_id=F.col(id_col), **options)
    if found is None:
        kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, item_words int, end_word int")
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", max_edits: float = MAX_EDITS,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, unchanged and with all their columns, in which no item is found.

    Same search as ``benchmark_matches``, as one filter per block of items: no
    row is shuffled. Rows with null or empty texts stay; repeated rows are
    judged alike; an empty table gives no rows.
    """
    out = _passes(benchmark, item_text_col, block_bytes,
                  lambda block, kept: _without(docs if kept is None else kept, block, text_col, max_edits))
    return docs if out is None else out


def _without(docs: DataFrame, block: list[tuple[object, str]], text_col: str, max_edits: float) -> DataFrame:
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, words = Items(block, max_edits), Words()
        for batch in batches:
            texts, bad, part, at, held = batch.column("txt"), set(), [], 0, 0
            for r in range(len(texts)):
                text = texts[r].as_py()
                part.append(words.of(text) if text else np.zeros(0, np.uint64))
                held += len(part[-1])
                if held > 1 << 20 or r == len(texts) - 1:
                    bad |= {at + m[0] for m in items.matches(part)} if items.words else set()
                    part, at, held = [], r + 1, 0
            yield batch.select(["__row"]).filter(pa.array([r not in bad for r in range(len(texts))], pa.bool_()))

    rows = packed(docs, txt=F.col(text_col))
    kind = rows.schema["__row"].dataType.simpleString()
    return rows.mapInArrow(kept, f"__row {kind}").select("__row.*")

"""Substring deduplication by Rabin-Karp hashes of fixed-length token windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from toolcorpus.llm.common import materialize, text_hash

WIDTH = 35
# Odd multipliers of the two hash lanes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
VOCABULARY = 1 << 18
ROWS_OUT = 1 << 16
# Windows in a run at most.
RUN = 32


class WordHashes(dict):
    """Word to slot, filled on demand; two 64-bit lanes per slot. Starts afresh when ``VOCABULARY`` is reached."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.lanes, self.digest = np.zeros((2, VOCABULARY), np.uint64), xxhash.xxh3_128_intdigest

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at >= self.lanes.shape[1]:
            self.lanes = np.concatenate([self.lanes, np.zeros_like(self.lanes)], axis=1)
        full = self.digest(word)
        self.lanes[0, at], self.lanes[1, at] = full >> 64, full & 0xFFFFFFFFFFFFFFFF
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > VOCABULARY:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.lanes[:, at]


class Rolling:
    """Rabin-Karp hashes modulo 2^64 of all runs of ``k`` words, by differences of running sums."""

    def __init__(self):
        self.powers = [np.ones(1, np.uint64)] * 2
        self.inverse = [np.ones(1, np.uint64)] * 2

    def hashes(self, words: np.ndarray, lane: int, k: int) -> np.ndarray:
        n = len(words)
        if len(self.powers[lane]) < n:
            size = max(n, 1 << 15)
            for table, base in ((self.powers, BASES[lane]), (self.inverse, pow(BASES[lane], -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                table[lane] = np.cumprod(steps)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.powers[lane][:n], out=sums[1:])
        return (sums[k:] - sums[:n + 1 - k]) * self.inverse[lane][:n + 1 - k]

    def spans(self, words: np.ndarray, lane: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words ``[start, end)``."""
        self.hashes(words, lane, 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.powers[lane][:len(words)])])
        return (sums[end] - sums[start]) * self.inverse[lane][start]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit words that leaves no order between near values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return best(out[:len(out) - rest], out[rest:]) if rest else out


def anchor_size(width: int) -> int:
    return max(1, width // 4)


def window_anchors(rolling: Rolling, lane: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``anchor_size`` words, and for each window the smallest of those inside it."""
    k = anchor_size(width)
    runs = _mixed(rolling.hashes(lane, 0, k))
    return runs, _sliding(runs, width - k + 1, np.minimum)


def document_anchors(runs: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes that are some window's smallest, with the number of places where they are so."""
    span = width - anchor_size(width) + 1
    pad = np.zeros(span - 1, np.uint64)
    chosen = _sliding(np.concatenate([pad, least, pad]), span, np.maximum) == runs
    return np.unique(runs[chosen], return_counts=True)


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("txt").cast(pa.binary()).to_pylist()


def _anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    vocabulary, rolling = WordHashes(), Rolling()
    for batch in batches:
        ids, ths = batch.column("id"), batch.column("th")
        rows, values, counts, held = [], [], [], 0
        texts = _texts(batch)
        for r, text in enumerate(texts):
            words = text.split() if text else []
            if len(words) >= width:
                v, n = document_anchors(*window_anchors(rolling, vocabulary.of(words)[0], width), width)
                rows.append(np.full(len(v), r))
                values.append(v)
                counts.append(n)
                held += len(v)
            if held and (held >= ROWS_OUT or r == len(texts) - 1):
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), ths.take(at), pa.array(np.concatenate(values).view(np.int64)),
                     pa.array(np.concatenate(counts).astype(np.int64))], ["id", "th", "anchor", "n"])
                rows, values, counts, held = [], [], [], 0


def window_runs(rolling: Rolling, lanes: np.ndarray, known: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """``(anchor, content, start, size)`` of each run of windows that share a known anchor, and all window hashes.

    A run has at most ``RUN`` windows; its content is the hash of all its words.
    """
    _, least = window_anchors(rolling, lanes[0], width)
    first = np.concatenate([[True], least[1:] != least[:-1]])
    begin = np.maximum.accumulate(np.where(first, np.arange(len(least)), 0))
    first |= (np.arange(len(least)) - begin) % RUN == 0
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(least)))
    hit = np.isin(least[start], known)
    start, size = start[hit], size[hit]
    content = rolling.spans(lanes[1], 1, start, start + size + width - 1)
    return least[start], content, start, size, rolling.hashes(lanes[1], 1, width)


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    vocabulary, rolling = WordHashes(), Rolling()
    for batch in batches:
        ids, ths, repeated = batch.column("id"), batch.column("th"), batch.column("anchors")
        rows, parts, hashes, held = [], [], [], 0
        texts = _unzipped(batch)
        for r, text in enumerate(texts):
            known = np.asarray(repeated[r].values, dtype=np.int64).view(np.uint64)
            *run, every = window_runs(rolling, vocabulary.of(text.split()), known, width)
            rows.append(np.full(len(run[0]), r))
            parts.append(run)
            at = np.repeat(run[2] - np.concatenate([[0], np.cumsum(run[3])[:-1]]), run[3]) + np.arange(run[3].sum())
            hashes.append(every[at])
            held += len(at)
            if held and (held >= ROWS_OUT or r == len(texts) - 1):
                where = pa.array(np.concatenate(rows))
                anchor, content, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
                ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(where), ths.take(where), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
                     pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hashes).view(np.int64)))],
                    ["id", "th", "anchor", "content", "start", "size", "hashes"])
                rows, parts, hashes, held = [], [], [], 0


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("th"), pa.array([None if t is None else len(t) for t in texts], pa.int64()),
             pa.array([None if t is None else pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())],
            ["id", "th", "n_bytes", "zipped"])


def _unzipped(batch: pa.RecordBatch) -> list:
    sizes = batch.column("n_bytes").to_pylist()
    return [None if z is None else pa.decompress(z, n, "zstd", asbytes=True) if n else b""
            for z, n in zip(batch.column("zipped").to_pylist(), sizes, strict=True)]


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals ``[from, to)`` covered by the given intervals; touching ones are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > ends[:-1])
    return starts[np.concatenate([[0], cut + 1])], ends[np.concatenate([cut, [len(starts) - 1]])]


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("from", pa.int32()), ("to", pa.int32())])
    for batch in batches:
        texts, runs = _unzipped(batch), batch.column("runs")
        n_words, n_gone, kept, spans, at, held = [], [], [], [], 0, 0
        for r, text in enumerate(texts):
            words = text.split() if text else []
            own, gone = [], 0
            if runs[r].is_valid:
                start, size = (np.asarray(runs[r].values.field(x), dtype=np.int64) for x in ("start", "size"))
                lo, hi = merged_spans(start, start + size + width - 1)
                own, gone = list(zip(lo.tolist(), hi.tolist(), strict=True)), int((hi - lo).sum())
                ends = [0, *hi.tolist()]
                words_kept = [w for a, b in zip(ends, [*lo.tolist(), len(words)], strict=True) for w in words[a:b]]
            else:
                words_kept = words
            n_words.append(len(words))
            n_gone.append(gone)
            kept.append(b" ".join(words_kept))
            spans.append([{"from": a, "to": b} for a, b in own])
            held += len(kept[-1])
            if r == len(texts) - 1 or held >= 1 << 24:
                out = [batch.column("id").slice(at, r + 1 - at), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()),
                       pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(span))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept_text", "spans"])
                n_words, n_gone, kept, spans, at, held = [], [], [], [], r + 1, 0


def _zipped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, th, n_bytes, zipped)``: texts compressed before they are shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("txt"))
    return rows.mapInArrow(_zip, f"id {rows.schema['id'].dataType.simpleString()}, th long, n_bytes long, zipped binary")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(id, th, runs)``: per document ``(start, size)`` of runs of windows that also start elsewhere.

    1. The anchor of a window is the smallest hash among its runs of
       ``anchor_size`` words. A window can only repeat if its anchor is some
       window's anchor in two places, so anchors, few per text, are counted.
    2. Consecutive windows with one such anchor are a run, with the hash of all
       its words and the Rabin-Karp hash of each window. Runs are counted by
       anchor and content: windows of a repeated run all repeat.
    3. Where an anchor has a content that occurs once, one run of each of its
       contents is taken apart and its windows are counted by anchor and hash.
       A repeated window of a content that occurs once is removed there.

    No repeated window is lost: equal windows have equal anchors. Counts by
    hash compare only windows with one anchor, so 128 bits decide.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("txt"))
    kind = rows.schema["id"].dataType.simpleString()
    anchors = materialize(rows.mapInArrow(lambda b: _anchors(b, width), f"id {kind}, th long, anchor long, n long"), "anchors")
    twice = materialize(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors-twice")
    known = materialize(anchors.join(twice, "anchor").groupBy("id", "th").agg(F.collect_set("anchor").alias("anchors")), "anchors-known")
    k, d = known.alias("k"), _zipped(docs, id_col, text_col).alias("d")
    near = d.join(k, F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.th") == F.col("k.th"))).select(
        "d.id", "d.th", "d.n_bytes", "d.zipped", "k.anchors")
    runs = materialize(near.mapInArrow(lambda b: _runs(b, width), f"id {kind}, th long, anchor long, content long, "
                                                                  "start int, size int, hashes array<long>"), "runs")
    key = ["anchor", "content", "size"]
    kinds = materialize(runs.groupBy(*key).agg(F.count("*").alias("n")), "run-kinds")
    whole = runs.join(kinds.where("n > 1").select(*key), key).select("id", "th", "start", "size")
    unlike = materialize(kinds.groupBy("anchor").agg(F.min("n").alias("least"))
                         .where("least = 1").select("anchor"), "anchors-unlike")
    single = (runs.join(unlike, "anchor").groupBy(*key)
              .agg(F.count("*").alias("n"), F.first(F.struct("id", "th", "start", "hashes")).alias("r")))
    wins = materialize(single.select("anchor", F.col("r.id").alias("id"), F.col("r.th").alias("th"), F.col("r.start").alias("start"),
                                     (F.col("n") == 1).alias("alone"), F.posexplode("r.hashes").alias("off", "h")), "windows")
    again = materialize(wins.groupBy("anchor", "h").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "h"), "windows-twice")
    part = wins.where("alone").join(again, ["anchor", "h"]).select(
        "id", "th", (F.col("start") + F.col("off")).alias("start"), F.lit(1).alias("size"))
    # A set: fully repeated rows share their runs, however many rows there are.
    return whole.union(part).groupBy("id", "th").agg(F.collect_set(F.struct("start", "size")).alias("runs"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, spans`` per row of ``docs``.

    Words are runs of anything but ASCII white space, unchanged. Each word
    covered by a window of ``width`` consecutive words whose sequence also
    starts anywhere else, in the same text too, is removed; windows are judged
    on the input. ``spans`` are the maximal removed intervals ``[from, to)`` in
    words, ``kept_text`` the rest joined by one space. A null or empty text has
    no words; fewer than ``width`` words have no window. Fully repeated rows
    are occurrences of their own, so both lose every window. Null identifiers
    are identifiers like any other; an empty table gives no rows; other columns
    are ignored.

    All work is per document or keyed by a hash: counts combine on the map
    side, joins on hot hashes are split at run time, and each level is written
    to the shared folder.
    """
    found = materialize(repeated_runs(docs, id_col, text_col, width), "repeated").alias("s")
    d = _zipped(docs, id_col, text_col).alias("d")
    kind = docs.schema[id_col].dataType.simpleString()
    both = d.join(found, F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.th") == F.col("s.th")), "left").select(
        "d.id", "d.n_bytes", "d.zipped", "s.runs")
    return both.mapInArrow(lambda b: _cut(b, width), f"doc_id {kind}, n_words long, n_removed long, kept_text string, "
                                                     "spans array<struct<from:int,to:int>>")

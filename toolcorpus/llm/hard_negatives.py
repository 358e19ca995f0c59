"""Hard-negative mining with exact scores by the method of the Four Russians."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from toolcorpus.llm.common import materialize

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
SCALE = 256
# Components from here on have scores beyond 64 bits; they count as not finite.
LARGEST = float(1 << 18)
# Pairs scored in one cell of the grid, and the most rows of either side in a cell.
CELL_PAIRS, CELL_ROWS = 1 << 26, 1 << 17
# Anchors whose tables are held at once, and candidates scored at once.
BLOCK, SLAB = 128, 2048


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``(id, label, v)`` of the rows that take part, with integer components ``floor(scale * x)``."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    return vectors.where(F.col(label_col).isNotNull() & x.isNotNull() & fine).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"),
        F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def planes(v: np.ndarray, width: int) -> np.ndarray:
    """Two's complement bit planes of integer vectors: ``(rows, width, groups)`` bytes, bit ``j`` of a byte for component ``8 g + j``."""
    bits = (v[:, None, :] >> np.arange(width)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def unpacked_planes(packed: np.ndarray) -> np.ndarray:
    """The integer vectors of ``planes``."""
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    weight = 1 << np.arange(packed.shape[1], dtype=np.int64)
    weight[-1] = -weight[-1]
    return (bits * weight[None, :, None]).sum(1)


def subset_sums(v: np.ndarray, kind: type) -> np.ndarray:
    """``(groups, 256, anchors)``: for eight components at a time, the sum of those that a byte selects."""
    groups = v.shape[1] // 8
    out = np.zeros((groups, 256, len(v)), kind)
    for g in range(groups):
        for j in range(8):
            np.add(out[g, :1 << j], v[:, 8 * g + j].astype(kind), out=out[g, 1 << j:2 << j])
    return out


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products ``(candidates, anchors)``: shift, then add what the bytes of a plane find in the tables."""
    n, width, groups = packed.shape
    total = np.zeros((n, tables.shape[2]), tables.dtype)
    found, plane = np.empty_like(total), np.empty_like(total)
    for b in range(width - 1, -1, -1):
        plane[:] = 0
        for g in range(groups):
            np.take(tables[g], packed[:, b, g], axis=0, out=found)
            plane += found
        if b == width - 1:
            np.negative(plane, out=total)  # the plane of the sign
        else:
            total <<= 1
            total += plane
    return total


def first_of(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest, larger ones first, ties by place."""
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        over = np.flatnonzero(s > least)
        at = np.concatenate([over, np.flatnonzero(s == least)[:k - len(over)]])
    else:
        at = np.arange(len(s))
    return at[np.lexsort((at, -s[at]))]


class Cell:
    """Candidates, sorted by identifier, and anchors that meet in one cell of the grid."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, width: int, bound: int):
        rows = rows.take(pc.sort_indices(rows["id"], null_placement="at_end"))
        self.ids, self.tags, self.anchors, self.width = rows["id"].combine_chunks(), rows["tag"].to_numpy(), anchors, width
        both = pa.chunked_array([*rows["label"].chunks, *anchors["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        self.labels, self.anchor_labels = both[:rows.num_rows], both[rows.num_rows:]
        self.packed, self.anchor_packed = self._packed(rows["bits"]), self._packed(anchors["bits"])
        self.kind = np.int32 if self.packed.shape[2] * 8 * bound * bound < 1 << 31 else np.int64

    def _packed(self, bits: pa.ChunkedArray) -> np.ndarray:
        flat = b"".join(bits.to_pylist())
        return np.frombuffer(flat, np.uint8).reshape(len(bits), self.width, -1)

    def scored(self, other: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(anchor, places of candidates, their scores)`` over the rows of the anchor's label, or over all but those."""
        for label in np.unique(self.anchor_labels):
            at, which = np.flatnonzero((self.labels == label) != other), np.flatnonzero(self.anchor_labels == label)
            for a in range(0, len(which) if len(at) else 0, BLOCK):
                tables = subset_sums(unpacked_planes(self.anchor_packed[which[a:a + BLOCK]]), self.kind)
                every = np.concatenate([scores(tables, self.packed[at[k:k + SLAB]]).T for k in range(0, len(at), SLAB)], axis=1)
                for i, column in zip(which[a:a + BLOCK].tolist(), every, strict=True):
                    yield i, at, column


class Found:
    """Rows found in a cell, gathered as columns."""

    def __init__(self):
        self.anchor, self.rank, self.place, self.score = [], [], [], []

    def add(self, anchor: int, rank: int, places: np.ndarray, score: np.ndarray) -> None:
        self.anchor.append(np.full(len(places), anchor))
        self.rank.append(np.full(len(places), rank, np.int32))
        self.place.append(places)
        self.score.append(score.astype(np.int64))

    def table(self, cell: Cell) -> pa.Table:
        flat = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
        anchor, place = flat(self.anchor, np.int64), flat(self.place, np.int64)
        return pa.table({"anchor_id": cell.anchors["id"].take(anchor), "anchor_tag": cell.anchors["tag"].take(anchor),
                         "positive_rank": flat(self.rank, np.int32), "id": cell.ids.take(place), "score": flat(self.score, np.int64)})


def best_positives(cell: Cell, k: int) -> pa.Table:
    """The ``k`` first rows of its label for each anchor, itself left out."""
    found, tags = Found(), cell.anchors["tag"].to_pylist()
    for a, at, column in cell.scored(other=False):
        first = first_of(column, k + 1)
        first = first[cell.tags[at[first]] != tags[a]][:k]
        found.add(a, 0, at[first], column[first])
    return found.table(cell)


def best_negatives(cell: Cell, k: int, low: int, high: int) -> pa.Table:
    """For each anchor and positive, the ``k`` first rows of other labels between ``low`` and ``high`` percent of its score."""
    found, asked = Found(), cell.anchors["asked"].to_pylist()
    for a, at, column in cell.scored(other=True):
        for q in asked[a]:
            least, most = -(-low * q["score"] // 100), high * q["score"] // 100
            fit = np.flatnonzero((column >= least) & (column <= most)) if least <= most else np.zeros(0, np.int64)
            first = fit[first_of(column[fit], k)]
            found.add(a, q["positive_rank"], at[first], column[first])
    return found.table(cell)


def grid(n_rows: int, n_anchors: int, parallel: int) -> tuple[int, int]:
    """``(columns of candidates, rows of anchors)`` of the grid: cells of bounded work and memory that move the fewest rows."""
    cells = max(math.ceil(n_rows * n_anchors / CELL_PAIRS), parallel)
    columns = min(cells, max(1, round(math.sqrt(cells * n_rows / max(1, n_anchors)))))
    columns = max(columns, math.ceil(n_rows / CELL_ROWS))
    return columns, max(math.ceil(cells / columns), math.ceil(n_anchors / CELL_ROWS))


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                        label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
                        low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become integers, ``floor(256 * x)``; a score is the exact integer
    inner product with the anchor, larger first, ties by the smaller identifier
    (null last). ``is_anchor`` tells the anchors by the columns of ``vectors``.
    An anchor's positives are its first ``positives`` other rows of its label;
    for each, the first ``negatives`` rows of another label whose score lies
    between ``low`` and ``high`` percent of the positive's are returned.

    Rows with a null label or vector, or a component that is null, not finite or
    ``2 ** 18`` or more, take no part. Vectors of fewer components than the
    longest count as filled up with zeros, empty ones too. Fully repeated rows are one row;
    rows that share only an identifier are rows of their own. A null identifier
    is one like any other, but no anchor by its number. An empty table, or one
    without anchors, gives no rows; other columns are ignored.

    Candidates are packed once into bit planes, a byte for eight components.
    Anchors are a stated set of queries, so they meet all rows in the cells of a grid:
    each candidate goes to every row of the grid, each anchor to every column.
    In a cell the sums of all subsets of eight components of an anchor are
    tabulated, and a candidate's score is shifted and added from the entries
    that its bytes select. Positives score only rows of the label, negatives
    only the others, so each pair is scored once. Cells keep ``positives`` or
    ``negatives`` rows for each query, which windows then merge.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, label_col)
    size = rows.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("most"), F.max(F.size("v")).alias("dims")).first()
    bound, dims = int(size["most"] or 0) + 1, -(-max(1, size["dims"] or 1) // 8) * 8
    width = bound.bit_length() + 1
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            n = np.diff(lists.offsets.to_numpy())
            for a in range(0, len(n), SLAB):
                part = n[a:a + SLAB]
                v = np.zeros((len(part), dims), np.int64)
                v[np.arange(dims)[None, :] < part[:, None]] = lists.slice(a, SLAB).flatten().to_numpy()
                bits = pa.array([r.tobytes() for r in planes(v, width)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, SLAB), batch.column("label").slice(a, SLAB), bits],
                                                 ["id", "label", "bits"])

    def table(df: DataFrame, name: str) -> DataFrame:
        once = df.mapInArrow(packed, f"id {kinds['id']}, label {kinds['label']}, bits binary").distinct()
        return materialize(once.withColumn("tag", F.xxhash64("id", "label", "bits")), name)

    candidates = table(rows, "vectors")
    anchors = table(quantised(vectors.where(is_anchor), id_col, vector_col, label_col), "anchors")
    columns, lines = grid(candidates.count(), anchors.count(), 4 * spark.sparkContext.defaultParallelism)
    left = candidates.select("*", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"),
                             F.pmod("tag", F.lit(columns)).cast("int").alias("column"))
    schema = f"anchor_id {kinds['id']}, anchor_tag bigint, positive_rank int, id {kinds['id']}, score bigint"

    def meet(queries: DataFrame, search) -> DataFrame:
        def run(mine: pa.Table, asking: pa.Table) -> pa.Table:
            if not mine.num_rows or not asking.num_rows:
                none = pa.array([], pa.int64())
                return pa.table({"anchor_id": asking["id"].slice(0, 0), "anchor_tag": none, "positive_rank": pa.array([], pa.int32()),
                                 "id": mine["id"].slice(0, 0), "score": none})
            return search(Cell(mine, asking, width, bound))

        right = queries.select("*", F.pmod(F.shiftright("tag", 20), F.lit(lines)).cast("int").alias("line"),
                               F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"))
        return left.groupBy("line", "column").cogroup(right.groupBy("line", "column")).applyInArrow(run, schema)

    best = [F.desc("score"), F.asc_nulls_last("id")]
    near = meet(anchors, lambda c: best_positives(c, positives)).withColumn(
        "positive_rank", F.row_number().over(Window.partitionBy("anchor_tag").orderBy(*best)))
    near = materialize(near.where(F.col("positive_rank") <= positives), "positives")
    asked = near.groupBy("anchor_tag").agg(F.collect_list(F.struct("positive_rank", "score")).alias("asked"))
    queries = materialize(anchors.join(asked.withColumnRenamed("anchor_tag", "tag"), "tag"), "queries")
    far = meet(queries, lambda c: best_negatives(c, negatives, low, high)).withColumn(
        "rank", F.row_number().over(Window.partitionBy("anchor_tag", "positive_rank").orderBy(*best)))
    pairs = near.select("anchor_tag", "positive_rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.where(F.col("rank") <= negatives).join(pairs, ["anchor_tag", "positive_rank"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

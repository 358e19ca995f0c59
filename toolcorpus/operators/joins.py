"""How joined rows are dealt to tasks, and when a dimension is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Rows dealt to one task: its time stays the same however many rows there are.
ROWS_PER_TASK = 20_000
# A dimension is broadcast only below this many bytes; beyond it Spark decides.
BROADCAST_MAX_BYTES = 8 << 20


def spread(df: DataFrame, rows: int, min_partitions: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Round-robin repartition into as many partitions as ``rows`` rows need, one per task slot at least.

    Files are split by bytes, so narrow rows come by the million in one split,
    and a join by shuffle leaves them in one task per key. CPU-heavy row
    expressions after it would run in as few tasks; here their number follows
    the number of rows.
    """
    slots = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(slots, -(-rows // rows_per_task)))


def bounded_side(side: DataFrame, n_bytes: int) -> DataFrame:
    """``side`` marked for broadcast if its size, as measured by the caller, is small; else as it is.

    Spark's own choice follows its threshold and its estimate, which multiplies
    the sizes of joined sides: a dimension of a few rows may be joined by
    shuffle, all rows of a key in one task.
    """
    return F.broadcast(side) if n_bytes <= BROADCAST_MAX_BYTES else side

"""Running totals over a whole table, without a task that sees all of it.

The rows are dealt out by ranges of the order, each range is sorted and
written once, the totals of the ranges (one row each) are summed up, and every
row adds what came before it inside its own range to what came before the range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from toolcorpus.plans.stages import materialize

_ROW_BITS = 33  # of monotonically_increasing_id


def prefix_scan(df: DataFrame, order: Sequence[str | Column], value: str | Column | None = None, out: str = "before",
                ranges: int | None = None, tie: Column | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before this one in ``order``; without a value, their number.

    Nulls come first, a null value counts as zero. The result does not depend
    on the partitions of ``df`` or on the number of ``ranges`` (the shuffle
    partitions by default) if ``order`` tells rows apart. Rows that it leaves
    equal follow each other in any order, and lie in one range unless ``tie``
    tells them apart. An empty table gives no rows. The sorted rows are
    written to the shared folder, so a lost executor reads them again.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(o) if isinstance(o, str) else o for o in order] + ([] if tie is None else [tie])
    names = [f"__scan_o{i}" for i in range(len(keys))]
    rows = df.select("*", *[k.alias(n) for n, k in zip(names, keys, strict=True)],
                     *([] if value is None else [F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0)).alias("__scan_v")]))
    at = F.monotonically_increasing_id()
    rows = rows.repartitionByRange(ranges, *names).sortWithinPartitions(*names).drop(*names).withColumn("__scan_at", at)
    rows = materialize(rows.withColumn("__scan_range", F.shiftright("__scan_at", _ROW_BITS)), "scan")
    total = F.count("*") if value is None else F.sum("__scan_v")
    # One row per range, so the driver sees as many as there are ranges.
    totals = sorted((r["__scan_range"], r["t"]) for r in rows.groupBy("__scan_range").agg(total.alias("t")).collect())
    start, starts = 0, []
    for r, t in totals:
        starts.append((r, start))
        start = start + t
    if not starts:
        return rows.drop("__scan_at", "__scan_range", "__scan_v").withColumn(out, F.lit(0).cast("bigint"))
    kind = "bigint" if value is None else next(f.dataType.simpleString() for f in rows.agg(F.sum("__scan_v").alias("s")).schema)
    offsets = F.broadcast(spark.createDataFrame([(int(r), s) for r, s in starts], f"__scan_range bigint, __scan_start {kind}"))
    if value is None:
        inside = F.col("__scan_at") - F.shiftleft("__scan_range", _ROW_BITS)
    else:
        before = Window.partitionBy("__scan_range").orderBy("__scan_at").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum("__scan_v").over(before), F.lit(0))
    rows = rows.withColumn("__scan_in", inside).join(offsets, "__scan_range")
    return rows.withColumn(out, (F.col("__scan_start") + F.col("__scan_in")).cast(kind)).drop("__scan_at", "__scan_range", "__scan_v", "__scan_in", "__scan_start")


def row_numbers(df: DataFrame, order: Sequence[str | Column], out: str = "row_number", ranges: int | None = None,
                tie: Column | None = None) -> DataFrame:
    """``df`` with its rows numbered from 0 in ``order``, without gaps; see ``prefix_scan``."""
    return prefix_scan(df, order, None, out, ranges, tie)

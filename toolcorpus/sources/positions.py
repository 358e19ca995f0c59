"""Identity by position: the place of a row in its source, kept by Parquet files.

A file's rows are numbered by the reader; the files, in the order of their
paths, are numbered through by their row counts. No row is shuffled for it: the
counts are one narrow row per file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from toolcorpus.operators.scan import prefix_scan


def read_positioned(spark: SparkSession, path: str, *columns: str, position: str = "row_no") -> DataFrame:
    """The columns of a Parquet source (all by default) and ``position``, 0 for its first row.

    Only the columns asked for are read. A column of the name ``position`` must not be among them.
    """
    source = spark.read.parquet(path)
    chosen = [F.col(f"`{c}`") for c in (columns or source.columns)]
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    sizes = source.select(place[0]).groupBy("__file").agg(F.count("*").alias("__n"))
    starts = prefix_scan(sizes, ["__file"], "__n", "__start").select("__file", "__start")
    rows = source.select(*chosen, *place).join(starts, "__file")
    return rows.withColumn(position, F.col("__start") + F.col("__row")).drop("__file", "__row", "__start")


def first_in_source_order(spark: SparkSession, path: str, n: int | None, *columns: str, position: str = "row_no") -> DataFrame:
    """A2/F2: the first ``n`` rows of the source as it is stored (all if ``n`` is 0 or none), with their position."""
    rows = read_positioned(spark, path, *columns, position=position)
    return rows.where(F.col(position) < n) if n else rows


def align_positional(*frames: DataFrame, position: str = "row_no") -> DataFrame:
    """F3 by position: the rows of all frames side by side, cut to the shortest.

    Each frame has ``position`` without gaps from 0; names of other columns must differ.
    """
    return reduce(lambda a, b: a.join(b, position), frames)

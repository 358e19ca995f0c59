"""Stage boundaries: materialise an intermediate as a table in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from toolcorpus.session import ensure_checkpoint_dir


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back.

    Cuts lineage (a lost executor recomputes from the written files, not from
    the raw input) and stops the optimizer from re-inlining expensive parse
    expressions into every consumer.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    # Intermediate tables go when the driver ends; until then a lost executor can read them again.
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

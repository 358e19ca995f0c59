"""A saved corpus that is brought up to date: only dialogues that changed are parsed again.

The corpus lies in a fixed number of buckets, partitions of one Parquet
dataset, dealt out by a hash of the identifier. Every row carries a digest of the raw
texts it was parsed from. A refresh compares the digests, parses what is new or
changed, and overwrites the buckets these rows lie in; the other rows of such a
bucket are copied as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from toolcorpus.operators.parse import parse_corpus, read_dialogues_columns
from toolcorpus.plans.stages import materialize

BUCKETS = 256


@dataclass(frozen=True)
class Refreshed:
    """Dialogues parsed, taken over as they were, and dropped because they left the raw table."""

    parsed: int
    kept: int
    dropped: int


def _exists(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, at, fs.exists(at)


def refresh_corpus(raw: DataFrame, path: str, call_mode: str = "balanced", buckets: int = BUCKETS) -> Refreshed:
    """A4/A5: bring the parsed corpus at ``path`` up to the raw dialogues ``(example_id, system, chat)``.

    Identifiers must be unique and not null. A run over unchanged dialogues
    parses and writes nothing; run again after a failure, it does what is left.
    ``buckets`` must be the same in every run.
    """
    spark = raw.sparkSession
    texts = read_dialogues_columns(raw)
    now = texts.select("example_id", F.md5(F.concat_ws("\x00", "system", "chat")).alias("digest"),
                       F.pmod(F.xxhash64("example_id"), F.lit(buckets)).cast("int").alias("bucket"))
    if not _exists(spark, path)[2]:
        fresh = parse_corpus(raw, call_mode).join(now, "example_id")
        fresh.write.partitionBy("bucket").parquet(path)
        return Refreshed(spark.read.parquet(path).count(), 0, 0)
    stored = spark.read.parquet(path)
    old = stored.select("example_id", F.col("digest").alias("was"), F.col("bucket").alias("old_bucket"))
    both = now.join(old, "example_id", "full")
    work = materialize(both.where(~F.col("digest").eqNullSafe(F.col("was"))).select(
        "example_id", "digest", F.coalesce("bucket", "old_bucket").alias("bucket"), F.col("digest").isNull().alias("gone")), "changed")
    counts = work.agg(F.count(F.when(~F.col("gone"), 1)).alias("parsed"), F.count(F.when(F.col("gone"), 1)).alias("gone")).first()
    total = now.count()
    if not counts["parsed"] and not counts["gone"]:
        return Refreshed(0, total, 0)
    touched = [r["bucket"] for r in work.select("bucket").distinct().collect()]  # at most the number of buckets
    changed = work.where(~F.col("gone"))
    fresh = parse_corpus(raw.join(changed.select("example_id"), "example_id", "left_semi"), call_mode).join(
        changed.select("example_id", "digest", "bucket"), "example_id")
    stay = stored.where(F.col("bucket").isin(touched)).join(work.select("example_id"), "example_id", "left_anti")
    new = materialize(fresh.unionByName(stay.select(*fresh.columns)), "refreshed")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    filled = {r["bucket"] for r in new.select("bucket").distinct().collect()}
    for b in set(touched) - filled:  # the last rows of these buckets left the raw table
        fs, at, there = _exists(spark, f"{path}/bucket={b}")
        if there:
            fs.delete(at, True)
    return Refreshed(counts["parsed"], total - counts["parsed"], counts["gone"])


def read_refreshed(spark: SparkSession, path: str) -> DataFrame:
    """The parsed corpus at ``path``, without its book-keeping columns."""
    return spark.read.parquet(path).drop("digest", "bucket")

"""Exact deduplication by a tree merge of sorted digest runs (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from toolcorpus.llm.common import ASCII_SPACE, materialize

RUNS = 64
FAN_IN = 2
KEY = ("digest", "check", "n_bytes")


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in ASCII_SPACE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def exchange(level: DataFrame, fan_in: int) -> DataFrame:
    """One round: runs hand their sorted digests to a partner, which merges them in order and keeps each digest's best row.

    Runs ``fan_in * i`` to ``fan_in * i + fan_in - 1`` meet as run ``i``. All
    of them are exchanged by the same ranges of digests, so a task holds one
    range of the runs it merges and an aggregate over sorted rows needs no
    other shuffle. A level has a digest once in a run, so no range is hot.
    """
    return (level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .repartitionByRange("digest").sortWithinPartitions("run", *KEY)
            .groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when equal after deleting ASCII white space. The row with
    the most code points in its original text stays, then the smallest
    identifier, a null identifier last; of fully repeated rows exactly one is
    marked ``kept``. A null or empty text is the text of no characters, and
    all of those are one group. An empty table gives no rows; other columns,
    whatever their names, are ignored.

    Every input partition belongs to one of ``runs`` runs. A run holds each of
    its digests once (map-side combine first), with the best row and the count,
    sorted by digest. Runs are exchanged in binomial rounds: in round ``k`` the
    runs whose numbers differ in bit ``k`` merge in order (``exchange``; with a
    larger ``fan_in``, in that digit), until one is left. A run is spread over
    ranges of digests, so none, not even the last, sits in one task, and every
    level is written sorted to the shared folder. Equality is verified at every
    level: rows merge only when SHA-256, a second 64-bit hash and the byte
    length of the text agree. Very long texts are digested where they are read
    and never shuffled.
    """
    norm = normalised(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"),
                       F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"))
    base = base.select("doc_id", "n_chars", F.sha2("norm", 256).alias("digest"), F.xxhash64("norm").alias("check"),
                       F.octet_length("norm").alias("n_bytes"), F.monotonically_increasing_id().alias("row"),
                       F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"))
    base = materialize(base, "digests")

    best = F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("absent"),
                    F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    level = base.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count("*").alias("n"))
    level = materialize(level.sortWithinPartitions("run", *KEY), "run")
    left = runs
    while left > 1:
        left = -(-left // fan_in)
        level = materialize(exchange(level, fan_in), "run")
    groups = level.where(F.col("n") > 1).select(*KEY, "best", "n")
    out = base.join(groups, list(KEY), "left")
    alone = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        F.col("digest").alias("text_sha256"))

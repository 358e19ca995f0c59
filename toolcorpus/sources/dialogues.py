"""Raw dialogues in, parsed corpus and pair datasets out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from toolcorpus.operators.parse import head, read_dialogues_columns

RAW_SCHEMA = "example_id bigint, system string, chat string"


def read_dialogues(spark: SparkSession, path: str, fmt: str = "parquet", max_samples: int | None = None) -> DataFrame:
    """A1 (+A2): raw (example_id, system, chat) rows; missing text -> ``""``; optional top-k cap by id.

    An absent ``system`` or ``chat`` column is empty text too.
    """
    reader = spark.read.schema(RAW_SCHEMA) if fmt == "json" else spark.read
    df = reader.format(fmt).load(path)
    for absent in {"system", "chat"} - set(df.columns):
        df = df.withColumn(absent, F.lit(""))
    df = df.select("example_id", "system", "chat")
    return head(read_dialogues_columns(df), max_samples)


def write_corpus(corpus: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A4: both splits in one Parquet dataset partitioned by ``split`` (a stage boundary)."""
    corpus.write.mode(mode).partitionBy("split").parquet(path)


def read_corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A5: reload a saved corpus; a split filter prunes partitions at planning time."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Reload materialised preference pairs."""
    return spark.read.parquet(path)


def write_pairs(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Materialise preference pairs."""
    pairs.write.mode(mode).parquet(path)

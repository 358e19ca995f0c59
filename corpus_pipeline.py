"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame. All but the last return the columns of ``docs``:

1. language_id: texts go unless half of their words with letters are in one of
   the learned languages, against a label for noise and unknown letters; evenly
   mixed languages stay;
2. line_dedup: later occurrences of repeated three-line windows go from the
   texts, ``n_chars`` follows; no document goes;
3. simhash_dedup: one document of each near-duplicate component stays;
4. decontaminate: documents that hold a benchmark item go;
5. mix_sources: documents repeated to target weights, in a global random order,
   with ``copy`` and ``shuffle_key``.

Nulls, empty texts, repeated rows and extra columns are handled as each
operator's docstring says; an empty table gives no rows. The language model is
learned from the stage's own input, and where that has no language labels
every document is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from toolcorpus.llm.common import materialize, table
from toolcorpus.llm.decontaminate import decontaminate
from toolcorpus.llm.language_id import accepted, fit
from toolcorpus.llm.line_dedup import line_dedup
from toolcorpus.llm.mixing import mix_sources
from toolcorpus.llm.queries import MIX_WEIGHTS
from toolcorpus.llm.simhash_dedup import simhash_dedup


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, fit(docs, key=F.col("doc_id"), other=True))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs, weights=MIX_WEIGHTS)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("simhash_dedup", near_duplicate_stage),
          ("decontaminate", benchmark_stage), ("mix_sources", mixing_stage)]

# Learned labels, fingerprints and edit distances are beyond SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

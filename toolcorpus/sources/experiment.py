"""Comparison reports and experiment documents (A6 write, A7, A8, A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from toolcorpus.functions.jsonx import is_json


def write_report(metrics: DataFrame, path: str, base_model: str, dataset: str, test_samples: int) -> None:
    """One JSON document {base_model, dataset, test_samples, results{model -> metrics}}.

    The per-model rows are folded into a map by one global aggregate over the
    (few) model rows; the output directory is created by the writer.
    """
    metric_cols = [c for c in metrics.columns if c != "model"]
    doc = metrics.agg(F.map_from_entries(F.collect_list(F.struct(
        "model", F.struct(*metric_cols)))).alias("results"))
    doc = doc.select(F.lit(base_model).alias("base_model"), F.lit(dataset).alias("dataset"),
                     F.lit(test_samples).cast("bigint").alias("test_samples"), "results")
    doc.coalesce(1).write.mode("overwrite").json(path)


def _document(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: its top-level keys with their JSON texts, whatever they are."""
    raw = spark.read.text(path, wholetext=True).where(F.length(F.trim("value")) > 0)
    return raw.select(F.from_json("value", "map<string,string>").alias("doc"))


def _entries(df: DataFrame, text: str, *keep: str, names: tuple[str, str]) -> DataFrame:
    return df.select(*keep, F.explode(F.from_json(text, "map<string,string>")).alias(*names))


def _models(spark: SparkSession, path: str) -> DataFrame:
    """(model, key, body): every entry of every model's result."""
    results = _document(spark, path).select(F.col("doc").getItem("results").alias("results"))
    return _entries(_entries(results, "results", names=("model", "m")), "m", "model", names=("key", "body"))


def read_experiment(spark: SparkSession, path: str) -> DataFrame:
    """experiment/report JSON -> long (model, metric, value) over every numeric result metric."""
    value = F.expr("try_cast(body AS double)")
    return _models(spark, path).where(value.isNotNull()).select("model", F.col("key").alias("metric"), value.alias("value"))


def experiment_configs(spark: SparkSession, path: str) -> DataFrame:
    """A10: (model, section, key, value): every nested object of a model flattened, other values under section ``""``.

    Values are kept as JSON text (lists stay lists); a display layer shows ``–`` for absent keys.
    """
    models = _models(spark, path)
    nested = F.col("body").startswith("{") & is_json(F.col("body"))
    inner = _entries(models.where(nested).withColumnRenamed("key", "section"), "body", "model", "section", names=("key", "value"))
    flat = models.where(~nested | F.col("body").isNull()).select("model", F.lit("").alias("section"), "key", F.col("body").alias("value"))
    return inner.unionByName(flat)


def experiment_sections(spark: SparkSession, path: str) -> DataFrame:
    """A10: (section, key, value) of every top-level object but the results (improvements, hardware and the like)."""
    top = _document(spark, path).select(F.explode("doc").alias("section", "body")).where("section <> 'results'")
    return _entries(top.where(F.col("body").startswith("{")), "body", "section", names=("key", "value"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """A10: the observation list with its position."""
    doc = _document(spark, path).select(F.from_json(F.col("doc").getItem("observations"), "array<string>").alias("observations"))
    return doc.select(F.posexplode("observations").alias("idx", "observation"))


def write_stats(stats: DataFrame, features: list[str], path: str) -> None:
    """One JSON document {splits{split -> rows}, features[...]}."""
    doc = stats.agg(F.map_from_entries(F.collect_list(F.struct("split", "n_rows"))).alias("splits"))
    doc.withColumn("features", F.array(*[F.lit(f) for f in features])).coalesce(1).write.mode("overwrite").json(path)

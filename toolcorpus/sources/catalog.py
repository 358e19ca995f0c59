"""Function-schema catalogue: read a JSON array of schemas, parse, flatten to parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PROPERTY_TYPE = "struct<type:string, description:string, enum:array<string>, default:string, format:string>"
SCHEMA_TYPE = (f"struct<name:string, description:string, parameters:struct<type:string, "
               f"properties:map<string,{PROPERTY_TYPE}>, required:array<string>>>")


def parse_schema(schema_json: Column) -> Column:
    return F.from_json(schema_json, SCHEMA_TYPE)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A3: a JSON array of schemas (one document per file) -> one row per function, file order kept."""
    raw = spark.read.text(path, wholetext=True)
    arr = F.from_json(F.col("value"), "array<string>")
    rows = raw.select(F.posexplode(arr).alias("function_idx", "schema_json"))
    return catalog_from_json(rows, "schema_json")


def catalog_from_json(df: DataFrame, col: str = "schema_json") -> DataFrame:
    """Schema texts -> (…, name, description, parameters struct)."""
    parsed = df.withColumn("_s", parse_schema(F.col(col)))
    return parsed.select(*df.columns, F.col("_s.name").alias("name"), F.col("_s.description").alias("description"),
                         F.col("_s.parameters").alias("parameters"))


def catalog_params(catalog: DataFrame) -> DataFrame:
    """Long form (function, param_idx, param, type, enum, default_json, format, required)."""
    req = F.coalesce(F.col("parameters.required"), F.array().cast("array<string>"))
    ex = catalog.select(F.col("name").alias("function"), req.alias("_req"),
                        F.posexplode(F.map_entries("parameters.properties")).alias("param_idx", "e"))
    return ex.select("function", F.col("param_idx").cast("bigint"), F.col("e.key").alias("param"),
                     F.col("e.value.type").alias("type"), F.col("e.value.enum").alias("enum"),
                     F.col("e.value.default").alias("default_json"), F.col("e.value.format").alias("format"),
                     F.array_contains("_req", F.col("e.key")).alias("required"))


def select_functions(catalog: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """Restrict the catalogue to chosen names (left-semi join; catalogue rows and order kept)."""
    return catalog.join(names.select(F.col(name_col).alias("name")).distinct(), "name", "left_semi")

"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from toolcorpus.plans.stages import materialize

# A dimension is broadcast only below this many bytes; beyond it the join shuffles.
BROADCAST_MAX_BYTES = 8 << 20
# ASCII white space (fixed values): space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\f\r"

__all__ = ["ASCII_SPACE", "BROADCAST_MAX_BYTES", "bounded_side", "connected_components", "hash_unit",
           "materialize", "packed", "table", "text_hash"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct ``__row`` beside named work columns, so no column name can clash."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("__row"),
                     *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, replaced: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``__row`` but those named in ``replaced``."""
    return [F.col("__row").getField(f.name).alias(f.name)
            for f in df.schema["__row"].dataType.fields if f.name not in replaced]


def text_hash(text: Column) -> Column:
    """64-bit hash that tells rows of one identifier with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hash_unit(*parts) -> Column:
    """Uniform double in [0, 1): the first 13 hex digits of ``md5`` over the parts joined by ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def bounded_side(side: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``side`` marked for broadcast if its measured size stays below ``max_bytes``, else as it is.

    The size is the length of the rows as JSON, an upper bound for narrow rows.
    """
    size = side.select(F.sum(F.length(F.to_json(F.struct(*side.columns))).cast("bigint") + 64).alias("n")).first()["n"]
    return F.broadcast(side) if (size or 0) <= max_bytes else side


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the undirected edges ``(u, v)``; the root is the smallest node.

    Alternating large-star and small-star rounds: each round makes at most as
    many edges as it reads, takes minima with map-side combine, joins by node
    (skewed nodes are split at run time) and is written to the shared folder,
    so a lost executor repeats one round at most. No edges give no rows.
    """
    e = materialize(edges.select("u", "v").where(F.col("u") != F.col("v"))
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")

    def sign(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    before = sign(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.union(e.select("v", "u")).toDF("u", "v")
        # Minima are written first: the join then reads two plain exchanges, and a hub's rows can be split.
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = materialize(both.join(low, "u").where(F.col("v") > F.col("u"))
                            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where(F.col("u") != F.col("v")).union(low.toDF("u", "v")).distinct())
        e = materialize(small, "cc")
        after = sign(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Mixing sources to target weights by Poisson replication (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from toolcorpus.llm.common import bounded_side, hash_unit, packed

# A Poisson mean above this is drawn as a sum of pieces, so exp(-mean) never underflows.
PIECE_MEAN = 8.0
# P(X > 64) for a mean of 8 is below 1e-33, far under the 2^-52 grid of the hash.
STEPS = 64


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, source_col: str = "source",
                 default_weight: float = 1.0, total: int | None = None) -> DataFrame:
    """``(src, rate, pieces, cdf)`` per source; ``cdf`` is the Poisson distribution of one piece's mean."""
    counts = docs.groupBy(F.col(source_col).cast("string").alias("src")).agg(F.count("*").alias("n"))
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("src").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("w", weight)
    sums = counts.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    whole = F.lit(float(sums["n"] or 0) if total is None else float(total))
    rate = whole * F.col("w") / (F.lit(float(sums["w"])) * F.col("n")) if sums["w"] else F.lit(0.0)
    out = counts.select("src", rate.alias("rate"))
    out = out.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE_MEAN).cast("int")))
    out = out.withColumn("mean", F.col("rate") / F.col("pieces"))
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, step, lambda acc: acc["cdf"])
    return out.select("src", "rate", "pieces", cdf.alias("cdf"))


def poisson_count(key: Column, seed: int) -> Column:
    """Sum over the pieces of the inverted distribution: how many steps of the cdf the hash has passed."""
    return F.aggregate(
        F.sequence(F.lit(0), F.col("pieces") - 1), F.lit(0),
        lambda a, i: a + F.size(F.filter("cdf", lambda c: c <= hash_unit(seed, i, key))))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, default_weight: float = 1.0,
                total: int | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """Documents repeated by source weight, in a global random order.

    Source ``s`` with ``n_s`` documents and weight ``w_s`` (``default_weight``
    if not listed; ``None`` lists rows without a source, which are a source of
    their own) has the mean repetition ``total * w_s / (sum of weights * n_s)``;
    ``total`` defaults to the number of rows. Each document's count is the
    Poisson distribution of that mean inverted at a hash of seed, identifier
    and text, so it depends neither on row order nor on partitions. Copies get
    ``copy`` (1, 2, ...) and ``shuffle_key``, a hash by which they are dealt
    over all partitions and sorted inside each; input columns of these two
    names are replaced, all others stay. Rows that agree in identifier and
    text draw the same count each; null identifiers and null texts hash as
    such. A weight of zero drops the source; an empty table gives no rows.

    One count per source with map-side combine, and one shuffle of the copies.
    The rates are broadcast only if their measured size is small; otherwise
    they are joined by shuffle.
    """
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("~")),
                            F.coalesce(F.md5(F.col(text_col)), F.lit("~"))))
    rates = bounded_side(source_rates(docs, weights, source_col, default_weight, total))
    rows = packed(docs, src=F.col(source_col).cast("string"), key=key).alias("d")
    r = rates.alias("r")
    drawn = rows.join(r, F.col("d.src").eqNullSafe(F.col("r.src"))).select(
        "__row", "key", poisson_count(F.col("key"), seed).alias("copies"))
    copies = drawn.select("__row", "key", F.explode(F.when(
        F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>"))).alias("copy"))
    shuffle_key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.col("copy").cast("string"),
                                                       F.col("key"))), 1, 15), 16, 10).cast("bigint")
    out = copies.withColumn("shuffle_key", shuffle_key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    fields = [f.name for f in docs.schema.fields if f.name not in ("copy", "shuffle_key")]
    return out.select(*[F.col("__row").getField(n).alias(n) for n in fields], "copy", "shuffle_key")

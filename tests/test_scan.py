import random

import pytest
from pyspark.sql import functions as F

from toolcorpus.operators.scan import prefix_scan, row_numbers


def plain(rows, value):
    out, total = [], 0
    for r in sorted(rows):
        out.append((*r, total))
        total += value(r)
    return out


@pytest.mark.parametrize("parts,ranges", [(1, 1), (3, 5), (11, 40)])
def test_running_totals_equal_a_plain_loop_for_any_partitions(spark, parts, ranges):
    rng = random.Random(parts)
    rows = [(rng.randrange(50), i, rng.randrange(100)) for i in range(700)]
    df = spark.createDataFrame(rows, "g long, i long, n long").repartition(parts)
    got = sorted(map(tuple, prefix_scan(df, ["g", "i"], "n", ranges=ranges).collect()))
    assert got == plain(rows, lambda r: r[2])
    got = sorted(map(tuple, row_numbers(df, ["g", "i"], ranges=ranges).collect()))
    assert got == plain(rows, lambda r: 1)


def test_ties_nulls_repeated_rows_and_no_rows(spark):
    rows = [("a", 1)] * 500 + [("b", None), (None, 2), ("c", -4)]
    df = spark.createDataFrame(rows, "k string, n int").repartition(4)
    got = row_numbers(df, ["k"], "at", ranges=6, tie=F.monotonically_increasing_id()).collect()
    assert sorted(r["at"] for r in got) == list(range(503))
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append(r["at"])
    assert by[None] == [0] and sorted(by["a"]) == list(range(1, 501)) and by["b"] == [501] and by["c"] == [502]
    sums = prefix_scan(df, ["k"], "n", ranges=3).collect()
    assert {r["before"] for r in sums if r["k"] == "a"} == set(range(2, 502))
    assert [r["before"] for r in sums if r["k"] == "c"] == [502]
    assert row_numbers(df.limit(0), ["k"]).count() == 0 and prefix_scan(df.limit(0), ["k"], "n").count() == 0


def test_a_hot_key_is_spread_over_the_ranges(spark):
    df = spark.range(20_000).select(F.lit("same").alias("k"), "id")
    scan = row_numbers(df, ["k"], ranges=8, tie=F.col("id"))
    largest = scan.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 10_000 and scan.agg(F.max("row_number")).first()[0] == 19_999

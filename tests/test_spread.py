"""Event rows are dealt to tasks by their number, and no join by event type gathers them."""

from pyspark.sql import functions as F

from toolcorpus.operators.joins import BROADCAST_MAX_BYTES, ROWS_PER_TASK, bounded_side, spread
from toolcorpus.sources import fixtures as FX


def _events(spark, path, n, types):
    spark.range(n).coalesce(1).select(
        F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"),
        F.element_at(F.array(*[F.lit(t) for t in types]), (F.col("id") % len(types) + 1).cast("int")).alias("event_type"),
        F.lit(1.5).alias("value"), F.format_string('{"k": %d}', F.col("id") % 90).alias("props")).write.parquet(f"{path}/events.parquet")
    return str(path)


def _largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_partitions_follow_the_number_of_rows(spark):
    df = spark.range(0, 1000, 1, 2)
    assert _largest(spread(df, 1000, min_partitions=2, rows_per_task=100)) <= 100 + 2
    assert spread(df, 1000, min_partitions=16, rows_per_task=100).rdd.getNumPartitions() == 16
    assert spread(spark.range(0), 0, min_partitions=3).count() == 0


def test_a_task_gets_no_more_events_when_the_table_grows(spark, tmp_path):
    n = 6 * ROWS_PER_TASK  # more than the four slots of the tests take at that size
    sf = _events(spark, tmp_path, n, ["view", "view", "view", "click"])
    tools, _, windows = FX.tool_dimension(spark, sf)
    ev = FX.call_events(spark, sf, tools, windows)
    assert ev.count() == n
    assert _largest(ev) <= ROWS_PER_TASK + 100
    assert _largest(FX.eval_rows(spark, sf)) <= 3 * (ROWS_PER_TASK + 100)


def test_events_of_one_type_are_not_gathered_without_a_broadcast_threshold(spark, tmp_path):
    sf = _events(spark, tmp_path, 2000, ["view"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = FX.eval_rows(spark, sf)
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert _largest(rows) < 3 * 2000
        assert rows.count() == 3 * 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_a_small_side_is_marked_for_broadcast(spark):
    side = spark.range(3)
    assert bounded_side(side, BROADCAST_MAX_BYTES + 1) is side
    assert "broadcast" in bounded_side(side, 100)._jdf.queryExecution().analyzed().toString().lower()


def test_no_events_give_no_rows(spark, tmp_path):
    assert FX.eval_rows(spark, _events(spark, tmp_path, 0, ["view"])).count() == 0


def test_rows_are_dealt_before_joins_to_small_tools_and_after_others(spark, tmp_path, monkeypatch):
    """One split is dealt by one task: what it deals is to be as narrow as the table."""
    sf, dealt = _events(spark, tmp_path, 300, ["view", "click", None]), []

    def noted(df, rows):
        dealt.append(df.columns)
        return spread(df, rows)

    monkeypatch.setattr(FX, "spread", noted)
    found = []
    for most in (BROADCAST_MAX_BYTES, 0):
        monkeypatch.setattr(FX, "BROADCAST_MAX_BYTES", most, raising=False)
        monkeypatch.setattr("toolcorpus.operators.joins.BROADCAST_MAX_BYTES", most)
        for source in (FX.eval_rows, FX.pair_input):
            found.append(sorted(map(tuple, source(spark, sf).collect()), key=repr))
    assert [("allowed_functions" in c) for c in dealt] == [False, False, True, True]
    assert len(found[0]) == 3 * 200 and len(found[1]) == 200
    assert found[:2] == found[2:]

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandline.operators import relational
from strandline.operators.sessions import replay

START = datetime(2024, 1, 1)


def after(spark, *events):
    data = [(u, START + timedelta(hours=h), i, a, p) for i, (u, h, a, p) in enumerate(events)]
    df = spark.createDataFrame(data, "user_id string, ts timestamp_ntz, event_id long, action string, presented long")
    return sorted(((r.user_id, r.token, r.expires_at and r.expires_at - START, r.refused) for r in replay(df).collect()), key=str)


def test_sessions(spark):
    week = timedelta(days=7)
    hours = lambda n: timedelta(hours=n)
    got = after(
        spark,
        ("a", 0, "login", None), ("a", 1, "login", None), ("a", 2, "login", None),  # two tokens are kept: 1 and 2
        ("a", 3, "refresh", 0), ("a", 4, "refresh", 1),  # 0 is gone, 1 becomes 4
        ("b", 0, "login", None), ("b", 200, "refresh", 5), ("b", 201, "logout", 5),  # too old after a week
        ("c", 0, "logout", None), ("d", 0, None, None), (None, 0, "login", None), ("e", 0, "login", None), ("e", 1, "logout", 11), ("e", 2, "refresh", 11),
    )
    assert got == sorted([("a", 2, week + hours(2), 1), ("a", 4, week + hours(4), 1), ("b", None, None, 1), ("c", None, None, 0), ("d", None, None, 0), (None, 10, week, 0), ("e", None, None, 1)], key=str)
    assert after(spark) == []


def test_a_user_of_many_events_is_folded_as_it_passes(spark):
    events = spark.range(50_000).selectExpr("'u' as user_id", "timestamp_seconds(id) as ts", "id as event_id", "'login' as action", "cast(null as long) as presented")
    assert sorted(r.token for r in replay(events).collect()) == [49_998, 49_999]
    plan = replay(events)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("blocks", [None, 1])
def test_bloom_filter_skips_nothing_wrongly(spark, blocks):
    """Also when it is so full that it lets all through."""
    files = spark.range(4000).selectExpr("if(id % 50 = 0, null, concat('r', id % 7)) as repo_id", "concat('f', id) as file_path", "concat('h', id % 3) as file_hash", "id")
    stored = spark.range(60_000 if blocks else 2000).selectExpr("concat('r', id % 7) as repo_id", "concat('f', id) as file_path", "concat('h', (id + id % 11 div 10) % 3) as file_hash", "if(id % 13 = 0, 'pending', 'completed') as status")
    got, want = (sorted(r.id for r in df.collect()) for df in (relational.changed_files_filtered(files, stored, blocks), relational.changed_files(files, stored)))
    assert got == want and 80 < len(got) < 4000


def test_files_that_are_surely_new_are_not_shuffled(spark):
    files = spark.range(5000).selectExpr("'r' as repo_id", "concat('f', id) as file_path", "'h' as file_hash")
    stored = spark.range(100).selectExpr("'r' as repo_id", "concat('f', id) as file_path", "'h' as file_hash", "'completed' as status")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = relational.changed_files_filtered(files, stored)
        branches = df._jdf.queryExecution().executedPlan().toString().split("\n+- ")[-1]
        joined = df._jdf.queryExecution().sparkPlan().children()
        new = joined.apply(0).toString()
        assert df.count() == 4900 and "SortMergeJoin" not in new and "BroadcastHashJoin" in new and "SortMergeJoin" in joined.apply(1).toString(), branches
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_tables(spark):
    files = spark.createDataFrame([("r", "f", "h")], "repo_id string, file_path string, file_hash string")
    stored = spark.createDataFrame([], "repo_id string, file_path string, file_hash string, status string")
    assert relational.changed_files_filtered(files, stored).count() == 1
    assert relational.changed_files_filtered(files.where("false"), stored).count() == 0
    assert relational.changed_files_filtered(files, files.withColumn("status", F.lit("completed"))).count() == 0

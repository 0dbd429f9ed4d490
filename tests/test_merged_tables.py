"""Tables that batches only add to: what a read gives, what it reads, and what is left when a batch dies."""

import re

import pytest
from pyspark.sql import functions as F

from strandline.sources.tables import MergedTable
from strandline.streaming.ingest import Store

FILES = "repo_id string, job_id string, file_path string, language string, content string"
PLAIN = "key string, repo_id string, n int"


def table(spark, path):
    return MergedTable(spark, str(path), PLAIN, "repo_id", "key", buckets=4)


def rows(spark, *given):
    return spark.createDataFrame(given, "repo_id string, key string, n int")


def state(t, *args):
    return sorted((r.repo_id, r.key, r.n) for r in t.read(*args).collect())


def test_newest_rows_of_a_key(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert state(t) == [] and t.newest() == 0
    t.add(rows(spark, ("r", "a", 1), ("r", "a", 2), ("r", "b", 3), ("q/=", "c", 4)), 10)
    t.add(rows(spark, ("r", "a", 9)), 11, forget=spark.createDataFrame([("q/=", "c")], "repo_id string, key string"))
    assert state(t) == [("r", "a", 9), ("r", "b", 3)] and t.newest() == 11
    t.add(rows(spark, ("r", "a", 5)), 10)  # older than what is there
    assert state(t) == [("r", "a", 9), ("r", "b", 3)]
    until = spark.createDataFrame([("r", 10)], "repo_id string, version long")
    assert state(t, None, until) == [("r", "a", 1), ("r", "a", 2), ("r", "a", 5), ("r", "b", 3)]
    before = state(t)
    t.compact(["r"])
    assert state(t) == before and t._rows(["r"]).count() == 2
    spark.sql(f"DROP TABLE {t.name}")  # as in a new session
    again = table(spark, tmp_path / "t")
    assert state(again) == before
    again.drop(["r"])
    assert state(again) == [] and not list((tmp_path / "t").glob("repo_id=r"))


def test_plan_reads_met_partitions_and_moves_no_old_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.ingest(spark.createDataFrame([(f"r{i}", "j", "a.py", "py", f"x = {i}\n") for i in range(6)], FILES))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = spark.createDataFrame([("r1", "j", "a.py", "py", "x = 7\n")], FILES).withColumn("file_hash", F.lit("h"))
        changed = store.changed(batch, ["r1"])
        plan = changed._jdf.queryExecution().executedPlan().toString()
        assert changed.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert re.search(r"PartitionFilters: \[isnotnull\(repo_id#\d+\), \(repo_id#\d+ = r1\)\]", scan) and "r2" not in scan
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("FileScan")  # the batch's side alone
    read = store.points.read(["r1", "r2"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in read and "Bucketed: true" in read and re.search(r"PartitionFilters: \[repo_id#\d+ IN \(r1,r2\)\]", read)


BATCHES = [
    [("r1", "a.py", "def one():\n    return 1\n"), ("r1", "b.py", "def two():\n    return 2\n\ndef three():\n    return 3\n"), ("r2", "a.py", "x = 1\n")],
    [("r1", "b.py", "def two():\n    return 22\n"), ("r2", "c.py", "y = 1\n"), ("r2", "a.py", "x = 1\n")],
    [("r1", "a.py", " "), ("r3", "z.py", "z = 1\n")],
    [("r1", "a.py", "def one():\n    return 1\n")],
]


def files(spark, batch):
    return spark.createDataFrame([(r, "j", p, "py", c) for r, p, c in batch], FILES)


def all_of(store):
    points = sorted((r.repo_id, r.file, r.name, r.code) for r in store.points.read().collect())
    meta = sorted((r.repo_id, r.file_path, r.file_hash, r.chunks_indexed, r.status) for r in store.metadata.read().collect())
    return points, meta, sorted((r.repo_id, r.n, r.chunks_indexed) for r in store.chunks.read().collect())


def check_sums(store):
    fresh = store.metadata.read().groupBy("repo_id").agg(F.count(F.lit(1)).alias("f"), F.sum("chunks_indexed").alias("c"))
    assert sorted((r.repo_id, r.f, r.c) for r in fresh.collect()) == all_of(store)[2]


def test_sums_follow_replaces_and_deletes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    for batch in BATCHES:
        store.ingest(files(spark, batch))
        check_sums(store)
    store.delete_repos(spark.createDataFrame([("r2",)], "id string"))
    check_sums(store)
    store.ingest(files(spark, BATCHES[0]))
    check_sums(store)
    assert {r.repo_id for r in store.chunks.read(["r2"]).collect()} == {"r2"}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """What the store holds after the first and after the second batch, when none dies."""
    store, states = Store(spark, str(tmp_path_factory.mktemp("whole")), 2), []
    for batch in BATCHES[:2]:
        store.ingest(files(spark, batch))
        states.append(all_of(store))
    return states


@pytest.mark.parametrize(("step", "after"), [("points", True), ("chunks", True), ("metadata", False), ("metadata", True)])
def test_a_batch_that_dies_loses_nothing(spark, tmp_path, whole, step, after):
    """It dies before or after the write of a table; what was there is there, and when the batch is run again all is as if it had not died."""
    store, (old, new) = Store(spark, str(tmp_path / "s"), 2), whole
    store.ingest(files(spark, BATCHES[0]))
    target = getattr(store, step)
    plain = target.add

    def dies(*args, **more):
        if after:
            plain(*args, **more)
        raise RuntimeError("driver lost")

    target.add = dies
    with pytest.raises(RuntimeError):
        store.ingest(files(spark, BATCHES[1]))
    target.add = plain
    if (step, after) != ("metadata", True):
        assert all_of(store)[1:] == old[1:]  # no file says that it is done, and no sum has changed
    assert {p[:3] for p in old[0] if p[1] == "a.py"} <= {p[:3] for p in all_of(store)[0]}  # files that the batch leaves alone
    store.ingest(files(spark, BATCHES[1]))
    assert all_of(store) == new
    check_sums(store)

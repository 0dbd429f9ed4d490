"""Ingestion end to end: files, stream, retries, dead letters, repeats and deletes."""

import json

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from strandline.operators import answers, embedding, relational, search
from strandline.functions.retry import with_retry
from strandline.sources.tables import PartitionedTable
from strandline.streaming import messages
from strandline.streaming.ingest import Store, run

CODE = "import os\n\ndef go():\n    return 1\n"


def message(path, content, job="j1", repo="r1", retries=0):
    return {"repo_id": repo, "job_id": job, "repo_url": "u", "file_path": path, "language": "py", "content": content, "retries": retries}


def test_partitions_are_pruned_and_replaced(spark, tmp_path):
    t = PartitionedTable(spark, str(tmp_path / "t"), "repo_id string, point_id long", by=["repo_id"], lookup=["point_id"])
    assert t.read().count() == 0
    t.append(spark.range(30).selectExpr("cast(id % 3 as string) as repo_id", "id as point_id"))
    one = t.read().where("repo_id = '1' and point_id = 4")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo_id" in plan and "EqualTo(point_id,4)" in plan and one.count() == 1
    t.replace_partitions(t.read().where("repo_id = '1' and point_id < 9"), spark.createDataFrame([("1",), ("2",), ("a/b=c",)], "repo_id string"))
    assert sorted(r.point_id for r in t.read().where("repo_id = '1'").collect()) == [1, 4, 7]
    assert {r.repo_id for r in t.read().collect()} == {"0", "1"}  # 2 was met and has no rows now
    t.append(spark.createDataFrame([("a/b=c", 5)], "repo_id string, point_id long"))
    t.drop_partitions(spark.createDataFrame([("a/b=c",)], "repo_id string"))
    assert {r.repo_id for r in t.read().collect()} == {"0", "1"}


def test_stream_ingests_and_repeats_change_nothing(spark, tmp_path):
    inbox, dead = tmp_path / "inbox", str(tmp_path / "dead")
    inbox.mkdir()
    lines = [message("a.py", CODE), message("b.py", CODE + "\n\nx = 1\n"), message("n.py", None), message("n.py", None, retries=3)]
    (inbox / "m.json").write_text("\n".join(map(json.dumps, lines)) + '\n{"broken": \n')
    store = Store(spark, str(tmp_path / "store"))
    run(spark, str(inbox), store, dead, str(tmp_path / "cp")).awaitTermination(120)
    points = store.points.read()
    assert sorted((r.file, r.name) for r in points.collect()) == [("a.py", "go"), ("b.py", "go"), ("b.py", "module_scope")]
    letters = spark.read.parquet(f"{dead}/*").collect()
    assert sorted(r.reason for r in letters) == ["Max retries reached", "malformed"]
    # the retry is in the inbox, and read again until it is a dead letter
    assert messages.drain(lambda: run(spark, str(inbox), store, dead, str(tmp_path / "cp"))) == 3
    letters = [r for r in spark.read.parquet(f"{dead}/*").collect() if r.reason != "malformed"]
    assert [(json.loads(r.payload)["file_path"], json.loads(r.payload)["retries"], r.reason) for r in letters] == [("n.py", "3", "Max retries reached")] * 2
    totals = spark.createDataFrame([("j1", 2), ("j2", 4)], "job_id string, total_files int")
    assert {r.job_id: (r.progress, r.status) for r in store.progress(totals).collect()} == {"j1": (100, "completed"), "j2": (0, "processing")}

    before, version = sorted(map(str, points.collect())), store.metadata.read().count()
    again = spark.createDataFrame([(m["repo_id"], m["job_id"], m["file_path"], "py", m["content"]) for m in lines[:2]], "repo_id string, job_id string, file_path string, language string, content string")
    assert store.ingest(again).count() == 0
    assert sorted(map(str, store.points.read().collect())) == before and store.metadata.read().count() == version
    changed = again.where("file_path = 'b.py'").withColumn("content", F.lit("y = 2\n"))
    store.ingest(changed)
    assert sorted((r.file, r.name) for r in store.points.read().collect()) == [("a.py", "go"), ("b.py", "module_scope")]
    found = answers.answer_question(store.points.read(), "where is go").first()
    assert found.sources and {s.file for s in found.sources} <= {"a.py", "b.py"}
    other = again.withColumns({"repo_id": F.lit("r2"), "job_id": F.lit("j2")})
    files_of = lambda repo: sorted(str(p) for p in (tmp_path / f"store/points/repo_id={repo}").glob("*.parquet"))
    before = files_of("r1")
    store.ingest(other)
    assert files_of("r1") == before and files_of("r2")  # only the partitions of the batch are written
    store.ingest(other.withColumn("content", F.lit(" ")))
    assert not store.points.read(["r2"]).count() and store.metadata.read().where("repo_id = 'r2' and chunks_indexed = 0").count() == 2
    repos, jobs = spark.createDataFrame([("r1",)], "id string"), spark.createDataFrame([("j1", "r1"), ("j2", "r2")], "id string, repo_id string")
    store.delete_repos(repos, jobs)
    assert store.points.read().count() == 0 and {r.repo_id for r in store.metadata.read().collect()} == {"r2"}
    assert {r.job_id for r in store.stages.read().collect()} == {"j2"}


def test_one_bad_message_does_not_fail_the_others(spark, tmp_path):
    inbox, dead = tmp_path / "inbox", str(tmp_path / "dead")
    inbox.mkdir()
    (inbox / "m.json").write_text("\n".join(json.dumps({"i": i, "retries": 0}) for i in range(8)))
    done: dict[int, int] = {}

    def work(batch, number):
        rows = batch.collect()
        if any(r.i == 5 for r in rows):
            raise ValueError("disk is full")
        for r in rows:
            done[r.i] = done.get(r.i, 0) + 1
        return batch.where("false").withColumn("error", F.lit(""))

    start = lambda cp: lambda: messages.process(messages.read_messages(spark, str(inbox), "i int, retries int"), work, str(inbox), dead, str(tmp_path / cp), "x:y")
    assert messages.drain(start("cp")) == 4 and done == {i: 1 for i in range(8) if i != 5}
    letters = spark.read.parquet(f"{dead}/*").collect()
    assert [(json.loads(r.payload)["i"], r.error, r.reason) for r in letters] == [("5", "disk is full", "Max retries reached")]
    for _ in range(3 * messages.OUTAGES + 1):  # a new checkpoint reads all messages again; batches of bad ones alone look like outages at first
        try:
            messages.drain(start("other"))
            break
        except StreamingQueryException as e:
            assert "disk is full" in str(e)
    # and overwrites no dead letters
    assert spark.read.parquet(f"{dead}/*").count() > 1


def test_routing(spark):
    rows = [("quota gone", 0), ("could not generate.py", 0), ("timeout", 0), ("timeout", 3)]
    df = spark.createDataFrame(rows, "error string, retries int")
    assert [(r.route, r.reason, r.retries) for r in relational.route_failures(df).collect()] == [
        ("dead_letter", "quota_hit", 0), ("dead_letter", "quota_hit", 0), ("retry", None, 1), ("dead_letter", "Max retries reached", 3),
    ]
    assert [r.route for r in relational.route_failures(df, strict=True).collect()][1] == "retry"


def test_status(spark):
    jobs = spark.createDataFrame([("j", "r", "processing", 7), ("k", "x", "failed", 1)], "id string, repo_id string, status string, progress int")
    repos = spark.createDataFrame([("r", "completed")], "id string, status string")
    assert [tuple(messages.job_status(jobs, repos, j).first()) for j in ("j", "k", "?")] == [("done", "completed", 7, None), ("done", "failed", 1, None), ("error", None, None, "malformed job id")]
    unknown = "00000000-0000-4000-8000-000000000000"
    assert messages.job_status(jobs, repos, unknown).first().error == "unknown job"
    polls = iter([("queued", 0), ("queued", 0), ("processing", 40), ("completed", 100)])
    now = lambda: spark.createDataFrame([("j", "x", *next(polls))], "id string, repo_id string, status string, progress int")
    assert [(e["event"], e["progress"]) for e in messages.status_events(now, lambda: repos, "j", wait=0)] == [("update", 0), ("update", 40), ("done", 100)]


def test_top_k_ties_and_empty(spark):
    p = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0])], "point_id int, vector array<double>")
    assert [r.point_id for r in search.top_k(p, [2.0, 0.0], 9).collect()] == [1, 2]
    assert answers.answer_question(p.where("false").selectExpr("*", "'f' file", "'n' name", "1 start_line", "1 end_line", "'c' code"), "q").first().sources == []


def test_retry_and_order(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return [1]

    assert with_retry(flaky, 3, (0, 0)) == [1] and len(calls) == 3
    answers.MODELS["failing"] = lambda prompt: 1 / 0
    prompts = spark.createDataFrame([("p",), (None,)], "p string")
    assert [r[0] for r in prompts.select(answers.summarise(F.col("p"), "failing", wait=(0, 0))).collect()] == [answers.UNAVAILABLE] * 2
    assert "No relevant" in prompts.select(answers.summarise(F.col("p"), "offline")).first()[0]
    got = spark.createDataFrame([(0, "a b"), (1, None), (2, "")], "i int, t string").select("i", embedding.embed(F.col("t")).alias("v")).orderBy("i").collect()
    assert got[1].v is None and not any(got[2].v) and abs(sum(x * x for x in got[0].v) - 1) < 1e-5


def test_flush_and_fan_out(spark):
    jobs = spark.createDataFrame([("j", "queued", 4, 0, 0, 0, 0), ("k", "failed", 2, 1, 1, 0, 50)], "id string, status string, total_files int, fetched_files int, processed_files int, stored_files int, progress int")
    counts = spark.createDataFrame([("j", 4, 2, 1)], "job_id string, fetched long, processed long, stored long")
    got = sorted(tuple(r) for r in messages.flush_progress(jobs, counts).collect())
    assert got == [("j", "queued", 4, 4, 2, 1, 58), ("k", "failed", 2, 1, 1, 0, 50)]
    repo = spark.createDataFrame([("r", "j", "u", 2)], "repo_id string, job_id string, repo_url string, retries int")
    files = spark.createDataFrame([("r", "a.py", "py", "x"), ("q", "b.py", "py", "y")], "repo_id string, path string, language string, content string")
    assert [(r.file_path, r.retries) for r in messages.fan_out(repo, files).collect()] == [("a.py", 0)]


def test_history_and_joins(spark, tmp_path):
    from strandline.sources.tables import append

    q = spark.createDataFrame([("q1", "a")], "question string, answer string")
    append(q, str(tmp_path / "h"))
    append(q, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    messages.publish(q, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    users = spark.createDataFrame([("e1", "n1")], "email string, username string")
    new = spark.createDataFrame([(1, "e1", "n1"), (2, "x", "n1"), (3, "x", "y")], "i int, email string, username string")
    assert {r.i: r.conflict for r in relational.registration_conflicts(new, users).collect()} == {1: "email", 2: "username", 3: None}

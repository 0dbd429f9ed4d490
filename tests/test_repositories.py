"""The source of repositories: what it opens, what it says of what it cannot read, and the fetch of repositories that stands on it."""

import json
import os
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

from strandline.sources import files, repositories
from strandline.sources.repositories import RepositoryReader
from strandline.streaming import ingest, messages

CODE = "import os\n\ndef go():\n    return 1\n"


@pytest.fixture
def root(tmp_path):
    for path, content in {"a/d/x.py": CODE, "a/y.js": "let a;", "a/z.bin": "no", "a/.gitignore": "x", "a/Makefile": "m", "a/bad.py": None, "b/u.py": "b = 1\n", "none/readme.zzz": "no", "é x/ü.go": "go"}.items():
        file = tmp_path / "root" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"\xff\xfe" if content is None else content.encode())
    return str(tmp_path / "root")


def opened(reader):
    """What a read of all partitions gives, and the paths that it opened below the root."""
    seen = []

    def hook(event, args):
        if event == "open" and isinstance(args[0], str):
            seen.append(args[0])

    sys.addaudithook(hook)
    before, plain = len(seen), reader._content

    def content(store, path):
        seen.append(path)
        return plain(store, path)

    reader._content = content
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    return rows, sorted(os.path.relpath(p, reader.root) for p in seen[before:] if p.startswith(reader.root))


def test_files_that_are_left_out_are_not_opened(root):
    os.symlink("/nowhere", f"{root}/a/dangling.bin")  # opening it would fail
    reader = RepositoryReader({"path": root, "splits": 3})
    left = list(reader.pushFilters([In(("suffix",), (".py", ".js")), EqualTo(("repo_id",), "a"), IsNotNull(("repo_id",)), GreaterThan(("length",), 0)]))
    assert left == [GreaterThan(("length",), 0)]
    rows, seen = opened(reader)
    assert seen == ["a/bad.py", "a/d/x.py", "a/y.js"] == sorted(f"a/{r[1]}" for r in rows)
    everything, seen = opened(RepositoryReader({"path": root}))
    assert len(everything) == len(seen) == 9


def test_plan_pushes_both_filters(spark, root):
    df = repositories.source_files(spark, root, ["a", "é x", "gone"])
    got = sorted((r.repo_id, r.path, r.language, r.content, r.error) for r in df.collect())
    assert got == sorted([("a", "d/x.py", "py", CODE, None), ("a", "y.js", "js", "let a;", None), ("é x", "ü.go", "go", "go", None), ("gone", None, None, None, "No such repository")], key=str)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "repo_id IN" not in plan.split("BatchScan")[0] and "suffix IN" not in plan.split("BatchScan")[0]  # no filter is left above the scan


def test_a_third_of_all_files_is_many_tasks(spark, tmp_path):
    docs = spark.range(90).select(F.lit("hot").alias("source"), F.concat("id", F.lit(".py")).alias("path"), F.encode(F.concat(F.lit("x="), "id"), "utf-8").alias("content"))
    assert repositories.write_files(docs, f"file://{tmp_path}") == 90
    parts = repositories.read_repositories(spark, f"file://{tmp_path}", splits=6).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 6 and sum(r["count"] for r in parts) == 90 and max(r["count"] for r in parts) < 30
    assert files.repo_size_kb(repositories.read_repositories(spark, str(tmp_path / "none"))).first()[0] == 2000


def test_reads_are_tried_again(root, monkeypatch):
    monkeypatch.setattr(repositories, "WAIT", (0, 0))
    reader, fails = RepositoryReader({"path": root, "splits": 1}), {"y.js": 2, "x.py": 9}
    plain = reader._content

    def content(store, path):
        if fails.get(name := os.path.basename(path), 0):
            fails[name] -= 1
            raise OSError("stale handle")
        return plain(store, path)

    reader._content = content
    got = {r[1]: (r[4], r[5]) for p in reader.partitions() for r in reader.read(p) if p.repo_id == "a"}
    assert got["y.js"] == (b"let a;", None) and got["d/x.py"] == (None, "stale handle")


def wanted(spark, *repos):
    return spark.createDataFrame([("u", f"j-{r}", r, 0) for r in repos], "repo_url string, job_id string, repo_id string, retries int")


def test_fetch(spark, root, tmp_path):
    fetched = ingest.fetch(spark, wanted(spark, "a", "none", "gone"), root, str(tmp_path / "inbox"))
    assert sorted(tuple(r) for r in fetched.collect()) == [("a", "j-a", "processing", 2, None), ("gone", "j-gone", "failed", 0, "no such repository"), ("none", "j-none", "failed", 0, ingest.NO_FILES)]
    sent = spark.read.json(str(tmp_path / "inbox")).collect()
    assert sorted((r.repo_id, r.job_id, r.file_path, r.language, r.retries) for r in sent) == [("a", "j-a", "d/x.py", "py", 0), ("a", "j-a", "y.js", "js", 0)]
    jobs = spark.createDataFrame([(f"j-{r}", "queued", "old", 9) for r in ("a", "none", "gone", "other")], "id string, status string, error_message string, total_files int")
    repos = spark.createDataFrame([(r, "fetching", "old") for r in ("a", "none", "gone", "other")], "id string, status string, error_message string")
    jobs, repos = ingest.fetched_states(jobs, repos, fetched)
    assert sorted(map(tuple, jobs.collect())) == [("j-a", "processing", "", 2), ("j-gone", "failed", "no such repository", 0), ("j-none", "failed", ingest.NO_FILES, 0), ("j-other", "queued", "old", 9)]
    assert sorted(map(tuple, repos.collect())) == [("a", "processing", ""), ("gone", "failed", "no such repository"), ("none", "failed", ingest.NO_FILES), ("other", "fetching", "old")]


def test_a_rate_limit_fails_its_repository_alone(spark, root, tmp_path, monkeypatch):
    listed = repositories.source_files(spark, root, ["a", "b"])
    limited = F.when(F.col("path") == "y.js", "API rate limit exceeded " + "x" * 300).otherwise(F.col("error"))
    monkeypatch.setattr(ingest, "source_files", lambda *_: listed.withColumn("error", limited))
    got = {r.repo_id: r for r in ingest.fetch(spark, wanted(spark, "a", "b"), root, str(tmp_path / "inbox")).collect()}
    assert (got["a"].status, len(got["a"].error), got["b"].status, got["b"].total_files) == ("failed", 200, "processing", 1)
    assert [r.repo_id for r in spark.read.json(str(tmp_path / "inbox")).collect()] == ["b"]


def test_fetch_stream(spark, root, tmp_path):
    """Fetched repositories send their files; one that is not there yet is tried again; empty ones are not."""
    inbox, outcomes, dead = tmp_path / "inbox", str(tmp_path / "outcomes"), str(tmp_path / "dead")
    messages.publish(wanted(spark, "a", "none", "late", "gone").coalesce(1), str(inbox))
    start = lambda: ingest.run_fetch(spark, str(inbox), root, str(tmp_path / "files"), outcomes, dead, str(tmp_path / "cp"))
    start().awaitTermination(120)
    os.makedirs(f"{root}/late")
    open(f"{root}/late/l.py", "w").write("l = 1\n")
    messages.drain(start)
    states = {}
    for r in sorted(spark.read.parquet(outcomes).collect(), key=lambda r: int(r.batch.split("-")[1])):
        states.setdefault(r.repo_id, []).append(r.status)
    assert states == {"a": ["processing"], "none": ["failed"], "late": ["failed", "processing"], "gone": ["failed"] * 4}
    assert {r.repo_id for r in spark.read.option("recursiveFileLookup", True).json(str(tmp_path / "files")).collect()} == {"a", "late"}
    letters = spark.read.option("recursiveFileLookup", True).parquet(dead).collect()
    assert [(json.loads(r.payload)["repo_id"], r.error, r.stream_origin) for r in letters] == [("gone", "no such repository", "repo:fetch")]

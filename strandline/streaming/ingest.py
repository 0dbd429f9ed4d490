"""The ingestion DAG as one streaming query: file messages -> chunks -> points -> tables, with counters.

The reference's three hand-overs become steps of one micro-batch. A batch that is run again replaces the same files, and a
file whose content is known and completed is skipped and still counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.functions import text as T
from strandline.operators import answers, chunking, embedding, relational
from strandline.schemas import FETCH_MESSAGE, FILE_METADATA, POINTS, PROCESS_MESSAGE
from strandline.sources.repositories import source_files
from strandline.sources.tables import KeptSums, MergedTable, PartitionedTable, file_key
from strandline.streaming import messages

class Store:
    """The tables of one deployment below ``path``. Points and files' metadata are bucketed alike, by repository and path; ``chunks`` keeps
    the numbers of files and chunks of repositories [AGG-1]. A batch adds to them and overwrites nothing."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.path = spark, path
        self.points = MergedTable(spark, f"{path}/points", f"file_key string, {POINTS}", "repo_id", "file_key", buckets)
        self.metadata = MergedTable(spark, f"{path}/file_metadata", f"file_key string, {FILE_METADATA}", "repo_id", "file_key", buckets)
        self.chunks = KeptSums(self.metadata, f"{path}/chunks", ["chunks_indexed"])
        self.stages = PartitionedTable(spark, f"{path}/stages", "job_id string, file_path string, stage string", by=["job_id"])

    def ingest(self, files: DataFrame, provider: str = "hashing") -> DataFrame:
        """[3.1] Ingests a batch (repo_id, job_id, file_path, language, content) and returns what failed, with ``error``.

        Of several messages about one file the last one in order of content hash counts, so a replay changes nothing. Only
        the partitions of the batch's repositories are read, each file is parsed once, and only new rows are written: points, then sums, then
        the metadata, whose rows say that a file is done. A batch that dies between two of these is run again as if it had not begun:
        its points are replaced by newer ones, and sums newer than the metadata are not read.
        """
        hashed = files.withColumn("file_hash", T.file_hash(F.col("content")))
        sound = "content is not null and file_path is not null and repo_id is not null"
        bad = hashed.where(f"not ({sound})").drop("file_hash").withColumn("error", F.lit("missing content"))
        good = hashed.where(sound)
        once = good.withColumn("nth", F.row_number().over(W.partitionBy("repo_id", "file_path").orderBy(F.desc("file_hash")))).where("nth = 1").drop("nth")
        met = [r.repo_id for r in good.select("repo_id").distinct().collect()]  # of a poll's messages
        todo = self.changed(once, met).persist()
        parsed = chunking.parse_files(todo.select("repo_id", F.col("file_path").alias("path"), "language", "content")).persist()
        try:
            version = self.metadata.next_version(met)
            named = lambda df, path: df.withColumn("file_key", file_key(F.col("repo_id"), F.col(path)))
            points = named(embedding.points(chunking.chunks_of(parsed), provider), "file")
            # points of a file are replaced as a whole, also where its new content has none
            self.points.add(points, version, forget=self._without(todo, points))
            heads = chunking.headers_of(parsed)
            summary = answers.offline_summary(F.col("file_path"), F.col("imports"), F.col("skeleton"))
            new = heads.join(todo.select("repo_id", "file_path", "file_hash"), ["repo_id", "file_path"]).select(
                "repo_id", "file_path", "file_hash", "imports", "exports", "skeleton", summary.alias("summary"), "chunks_indexed", F.lit("completed").alias("status"), F.current_timestamp().alias("updated_at")
            )
            new = named(new, "file_path").persist()
            self.chunks.add(new, met, version)
            self.metadata.add(new, version)
            new.unpersist()
        finally:
            parsed.unpersist()
            todo.unpersist()
        # every file of the batch counts in every stage, skipped ones too; once, however often it is listed here
        seen = good.select("job_id", "file_path", F.explode(F.array(*map(F.lit, ("fetched", "processed", "stored")))).alias("stage"))
        self.stages.append(seen.distinct())
        return bad

    def changed(self, files: DataFrame, met: Sequence[str]) -> DataFrame:
        """[FLT-3, JOIN-4] The files that are new, changed or not completed: by one key, in whose buckets the metadata already are."""
        old = self.metadata.read(met).where("status = 'completed'").select(F.col("file_key").alias("known"), F.col("file_hash").alias("known_hash"))
        keyed = files.withColumn("file_key", file_key(F.col("repo_id"), F.col("file_path")))
        both = keyed.join(old, F.col("file_key") == F.col("known"), "left")
        return both.where("known_hash is null or known_hash <> file_hash").drop("known", "known_hash")

    @staticmethod
    def _without(todo: DataFrame, points: DataFrame) -> DataFrame:
        return todo.select("repo_id", "file_key").join(points.select("file_key").distinct(), "file_key", "left_anti")

    def progress(self, totals: DataFrame) -> DataFrame:
        """[AGG-2..4] Progress and status of the jobs of ``totals`` (job_id, total_files)."""
        own = self.stages.read().join(totals.select("job_id").distinct(), "job_id", "left_semi")
        counts = totals.join(relational.stage_counts(own), "job_id", "left").na.fill(0)
        return relational.job_progress(counts)

    def delete_repos(self, repos: DataFrame, jobs: DataFrame | None = None) -> None:
        """[DEL-1, DEL-3] Removes all that belongs to repositories (id): their points, their files' metadata and sums and, by ``jobs`` (id,
        repo_id), the progress of their jobs. Rows of other tables go by ``upsert.cascade_delete``."""
        gone = [r.id for r in repos.select("id").distinct().collect()]  # a request's worth
        for table in (self.metadata, self.points, self.chunks.kept):
            table.drop(gone)
        if jobs is not None:
            self.stages.drop_partitions(jobs.where(F.col("repo_id").isin(*gone)).select(F.col("id").alias("job_id")))


#: Fixed value: the error of a repository without files.
NO_FILES = "No files returned from GitHub"


def fetch(spark: SparkSession, repo_messages: DataFrame, root: str, inbox: str) -> DataFrame:
    """[STR-6, SRC-1, SRC-2, FLT-1, AGG-6] The step from repositories to files: reads the source files of the repositories of ``repo_messages``
    (repo_url, job_id, repo_id; a poll's worth) below ``root`` in one scan, and writes a message for each file to the folder ``inbox``.

    Returns (repo_id, job_id, status, total_files, error) for each message: "processing" with its number of files, or "failed" with the
    first 200 characters of the error. A repository without files has failed, with ``NO_FILES``; one that cannot be listed, or meets a
    rate limit, sends no messages. Files that cannot be read are left out, as files that are no text.
    """
    repos = [r.repo_id for r in repo_messages.select("repo_id").distinct().collect()]
    listed = source_files(spark, root, repos).persist(StorageLevel.DISK_ONLY)
    try:
        fatal = F.col("path").isNull() | T.is_rate_limit(F.col("error"))
        broken = listed.where("error is not null").where(fatal).groupBy("repo_id").agg(F.min("error").alias("error"))
        counts = listed.where("error is null").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
        both = repo_messages.join(counts, "repo_id", "left").join(broken, "repo_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        error = F.when(F.col("error").isNotNull(), T.truncate_error(F.lower("error"))).when(F.col("n") == 0, NO_FILES)
        # both sides that are broadcast have a row for a message of the poll; contents are not shuffled, however many one repository has
        sent = listed.where("error is null").join(F.broadcast(broken), "repo_id", "left_anti")
        messages.fan_out(F.broadcast(repo_messages), sent).write.mode("overwrite").option("compression", "gzip").json(inbox)
        done = both.select("repo_id", "job_id", F.when(error.isNull(), "processing").otherwise("failed").alias("status"), F.when(F.col("error").isNull(), F.col("n")).otherwise(0).cast("int").alias("total_files"), error.alias("error"))
        return spark.createDataFrame(done.toArrow(), done.schema)  # as many rows as there were messages
    finally:
        listed.unpersist()


def fetched_states(jobs: DataFrame, repos: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[UPD-1, Q5, Q13] ``jobs`` and ``repos`` with the outcomes of ``fetch``: state, number of files and error; others as they were."""
    new = {"status": F.coalesce("new_status", "status"), "error_message": F.when(F.col("new_status").isNotNull(), F.coalesce("new_error", F.lit(""))).otherwise(F.col("error_message"))}
    by_job = fetched.groupBy(F.col("job_id").alias("id")).agg(F.max("status").alias("new_status"), F.max("error").alias("new_error"), F.max("total_files").alias("n"))
    by_repo = fetched.groupBy(F.col("repo_id").alias("id")).agg(F.max("status").alias("new_status"), F.max("error").alias("new_error"))
    jobs_now = jobs.join(by_job, "id", "left").withColumns(new | {"total_files": F.coalesce("n", "total_files")}).select(*jobs.columns)
    return jobs_now, repos.join(by_repo, "id", "left").withColumns(new).select(*repos.columns)


def run_fetch(spark: SparkSession, inbox: str, root: str, file_inbox: str, outcomes: str, dead: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """[STR-6] Fetches repositories as their messages come: messages of files go to ``file_inbox``, outcomes to ``outcomes``, each to a
    folder of the batch, which a batch that is run again replaces. A repository that could not be listed is tried again, and a dead
    letter in the end; an empty one has failed for good."""
    name = messages.run_id(spark, checkpoint)

    def work(batch: DataFrame, number: int) -> DataFrame:
        fetched = fetch(spark, batch, root, f"{file_inbox}/fetched-{name}-{number}")
        fetched.write.mode("overwrite").parquet(f"{outcomes}/batch={name}-{number}")
        failed = fetched.where((F.col("status") == "failed") & (F.col("error") != NO_FILES)).select("repo_id", "job_id", "error")
        return batch.join(failed, ["repo_id", "job_id"])

    return messages.process(messages.read_messages(spark, inbox, FETCH_MESSAGE), work, inbox, dead, checkpoint, "repo:fetch", once=once)


def run(spark: SparkSession, inbox: str, store: Store, dead: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Ingests the file messages of a folder as they come."""
    stream = messages.read_messages(spark, inbox, PROCESS_MESSAGE)

    def work(batch: DataFrame, number: int) -> DataFrame:
        failed = store.ingest(batch)
        return failed

    return messages.process(stream, work, inbox, dead, checkpoint, "file:process", once=once)

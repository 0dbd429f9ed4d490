"""[STR-*, SRC-7, SNK-1, SNK-2] Message folders as streams, with retries, dead letters and progress.

A folder of files is a stream; the checkpoint of a query stands for consumer groups, acknowledgements and the replay of
messages that were being worked on when a worker died [STR-1, STR-2, STR-3]. Delivery is at least once and every sink
here is idempotent: it is keyed by batch, or by what a message is about.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from strandline.functions import text
from strandline.operators.relational import LIMITS, latest, route_failures
from strandline.schemas import schema

CORRUPT = "_corrupt"
#: Files of a poll, and the life of a job's progress without news, in seconds.
FILES_PER_POLL, PROGRESS_TTL = 5, 86_400
STAGES = ("fetched", "processed", "stored")
COUNTERS = ", ".join(f"{s} long" for s in STAGES)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: [STR-3] Seconds after which a message that was taken and not acknowledged is taken again.
IDLE_SECONDS = 300
#: How often a batch may end in an outage before its messages are blamed.
OUTAGES = 3
#: Seconds between the polls of a status stream.
STATUS_POLL = 2.0


def read_messages(spark: SparkSession, path: str, fields: str | StructType, files_per_poll: int = FILES_PER_POLL) -> DataFrame:
    """[SRC-7, STR-12] A stream of JSON messages; one that does not fit the schema has its text in ``_corrupt``. Folders below
    ``path`` are read too: that is where ``settle`` puts messages that are tried again."""
    wanted = StructType(list((schema(fields) if isinstance(fields, str) else fields).fields)).add(CORRUPT, "string")
    reader = spark.readStream.schema(wanted).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.option("maxFilesPerTrigger", files_per_poll).option("recursiveFileLookup", True).json(path)


def publish(df: DataFrame, path: str) -> None:
    """[SNK-1, SRC-8] Appends messages."""
    df.write.mode("append").json(path)


def dead_letters(failed: DataFrame, origin: str, now: F.Column | None = None) -> DataFrame:
    """[SNK-2] Failed messages as dead letters: the message as text, where it came from, the error and the reason."""
    kept = [c for c in failed.columns if c not in ("error", "reason", "route")]
    payload = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in kept)))
    return failed.select(
        payload.alias("payload"),
        F.lit(origin).alias("stream_origin"),
        "error",
        "reason",
        (F.current_timestamp() if now is None else now).alias("failed_at"),
    )


def settle(failed: DataFrame, inbox: str, dead: str, origin: str, batch: int, max_retries: int = 3, run: str = "0") -> None:
    """[STR-4, STR-5] Sends failed messages (…, retries, error) back to the inbox with one more retry, or to the dead letters.

    Both are written to a folder of their own run and batch: a batch that is run again replaces what it wrote before, and a stream
    with a new checkpoint replaces nothing.
    """
    name = f"{origin.replace(':', '-')}-{run}-{batch}"
    routed = route_failures(failed, max_retries).persist()
    try:
        again = routed.where("route = 'retry'").drop("route", "reason", "error")
        again.write.mode("overwrite").json(f"{inbox}/retry-{name}")
        gone = dead_letters(routed.where("route = 'dead_letter'"), origin)
        gone.write.mode("overwrite").parquet(f"{dead}/{name}")
    finally:
        routed.unpersist()


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to; made with the checkpoint and gone with it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(checkpoint, "run")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(folder, uuid.uuid4().hex[:12]), False).close()
    return min(x.getPath().getName() for x in fs.listStatus(folder))


class Outage(RuntimeError):
    """Whatever is tried fails alike: it is not the messages. The batch is to be run again."""


def _said(e: Exception) -> str:
    return (str(getattr(e, "desc", None) or e).strip().splitlines() or ["failed"])[-1]


def work_off(work: Callable[[DataFrame, int], DataFrame], batch: DataFrame, number: int, held: list[DataFrame], depth: int = 0, outages: bool = True) -> DataFrame:
    """What ``work`` says has failed. Where it raises, the batch is quartered, by two bits after the other of the messages' hashes, until
    the messages that make it raise are alone; these have failed, with what was raised as their error, and all others are done.
    ``work`` may see a message several times. ``held`` gets what is kept in memory and is to be let go by the caller.

    With ``outages``, a batch of several messages whose parts all raise the same error raises ``Outage`` before any message is blamed.
    """

    def tried(part: DataFrame) -> DataFrame:
        failed = work(part, number).persist()
        held.append(failed)
        failed.count()
        return failed

    try:
        return tried(batch)
    except Exception as e:
        first = e
    if depth > 48 or batch.limit(2).count() <= 1:  # one message, or several of the same hash
        return batch.withColumn("error", F.lit(_said(first)))
    parts: list[DataFrame] = []
    while len(parts) < 2 and depth <= 48:
        bits = F.pmod(F.shiftright(F.xxhash64(*batch.columns), depth), F.lit(4))
        parts, depth = [p for p in (batch.where(bits == n) for n in range(4)) if not p.isEmpty()], depth + 2
    done, broken = [], []
    for part in parts:
        try:
            done.append(tried(part))
        except Exception as e:
            broken.append((part, e))
    if outages and len(parts) > 1 and len(broken) == len(parts) and {_said(e) for _, e in broken} == {_said(first)}:
        raise Outage(_said(first)) from first
    for part, _ in broken:
        done.append(work_off(work, part, number, held, depth, False))
    return reduce(DataFrame.unionByName, done)


def process(
    messages: DataFrame,
    work: Callable[[DataFrame, int], DataFrame],
    inbox: str,
    dead: str,
    checkpoint: str,
    origin: str,
    max_retries: int = 3,
    once: bool = True,
) -> StreamingQuery:
    """[STR-1..7, STR-12] Runs ``work`` on each batch of messages; it returns those that failed, with ``error``. A message that
    makes it raise has failed too. Failed messages come back by the inbox, up to ``max_retries`` times. In an outage, when all that is
    tried fails alike, the query ends with the error, no message is blamed, and the checkpoint runs the batch again when the query is
    started again; after ``OUTAGES`` such ends the batch's messages are blamed one by one.

    Messages that fit no schema go to the dead letters at once. ``once`` takes what is there and stops; ``drain`` goes on until
    nothing is left to try.
    """
    spark = messages.sparkSession
    run = run_id(spark, checkpoint)

    def path_of(name: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def marks(folder: str) -> int:
        fs, p = path_of(folder)
        return len(fs.listStatus(p)) if fs.exists(p) else 0

    def mark(name: str) -> None:
        fs, p = path_of(name)
        fs.create(p, True).close()

    def on_batch(batch: DataFrame, number: int) -> None:
        held = [batch.persist()]
        try:
            bad = batch.where(F.col(CORRUPT).isNotNull()).select(
                F.col(CORRUPT).alias("payload"), F.lit(origin).alias("stream_origin"), F.lit("malformed payload").alias("error"), F.lit("malformed").alias("reason"), F.current_timestamp().alias("failed_at")
            )
            bad.write.mode("overwrite").parquet(f"{dead}/malformed-{origin.replace(':', '-')}-{run}-{number}")
            good = batch.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
            ends = marks(f"{checkpoint}/outages/{number}")
            try:
                failed = work_off(work, good, number, held, outages=ends < OUTAGES)
            except Outage:
                mark(f"{checkpoint}/outages/{number}/{ends}")
                raise
            settle(failed, inbox, dead, origin, number, max_retries, run)
        finally:
            for kept in held:
                kept.unpersist()

    writer = messages.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")).start()


def drain(start: Callable[[], StreamingQuery], rounds: int = 100) -> int:
    """Starts a query of ``process`` again until it finds no messages; how often it found some. Raises if there are still some after
    ``rounds``."""
    for n in range(rounds):
        query = start()
        query.awaitTermination()
        if not sum(p.numInputRows for p in query.recentProgress):
            return n
    raise TimeoutError(f"there are still messages after {rounds} rounds")


def fan_out(repo_messages: DataFrame, files: DataFrame) -> DataFrame:
    """[STR-6] One message for each file of each fetched repository."""
    return repo_messages.join(files, "repo_id").select(
        "repo_id", "job_id", "repo_url", F.col("path").alias("file_path"), "language", "content", F.lit(0).alias("retries")
    )


def unacknowledged(taken: DataFrame, acks: DataFrame, idle_seconds: int = IDLE_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """[STR-3] The messages of the stream ``taken`` (message_id, taken_at) without a row in the stream ``acks`` (message_id, acked_at) within
    ``idle_seconds``: each comes out once, when the watermarks of both streams have passed its time, and is to be worked on again. What is
    kept is bounded by the same time on both sides."""
    t = taken.withWatermark("taken_at", delay)
    a = acks.select(F.col("message_id").alias("acked_id"), "acked_at").withWatermark("acked_at", delay)
    in_time = F.expr(f"acked_at between taken_at and taken_at + interval {int(idle_seconds)} seconds")
    return t.join(a, (F.col("message_id") == F.col("acked_id")) & in_time, "left_outer").where("acked_id is null").select("message_id", "taken_at")


def minute_counts(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """[CTL-1] A stream (endpoint, client, minute, n) of the requests of a client to an endpoint in each minute, from a stream (endpoint,
    subject, address, ts); a client is known by the token's subject, else by the address. Minutes are kept until the watermark has
    passed their end; requests that come later are not counted."""
    client = F.coalesce("subject", "address").alias("client")
    counted = requests.withWatermark("ts", delay).groupBy("endpoint", client, F.window("ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("endpoint", "client", F.col("w.start").alias("minute"), "n")


def run_limits(requests: DataFrame, table: str, checkpoint: str, delay: str = "10 minutes", once: bool = True) -> StreamingQuery:
    """[CTL-1] Keeps the counts of ``minute_counts`` in ``table``, a folder for each batch, which a batch that is run again replaces."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = minute_counts(requests, delay).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def read_limits(spark: SparkSession, table: str, limits: dict[str, int] = LIMITS) -> tuple[DataFrame, DataFrame]:
    """[CTL-1] (counts, over): the last count of each minute of ``run_limits``, and those that are over their endpoint's limit."""
    counts = latest(spark.read.parquet(table), ["endpoint", "client", "minute"], F.desc("batch")).drop("batch")
    limit = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col("endpoint")]
    return counts, counts.where(F.col("n") > limit)


def flush_progress(jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """[STR-9, STR-10, Q13] Jobs with the counters and progress of (job_id, fetched, processed, stored); others as they were."""
    stages = ("fetched", "processed", "stored")
    new = counts.select(F.col("job_id").alias("id"), *(F.col(s).alias(f"{s}_new") for s in stages))
    both = jobs.join(new, "id", "left")
    shown = text.progress(*(F.col(f"{s}_new") for s in stages), F.col("total_files"))
    values = {f"{s}_files": F.coalesce(F.col(f"{s}_new").cast("int"), F.col(f"{s}_files")) for s in stages}
    return both.withColumns(values | {"progress": F.coalesce(shown, F.col("progress"))}).select(*jobs.columns)


class Counters(StatefulProcessor):
    """The counters of a job, forgotten ``ttl_seconds`` after its last message."""

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counters", COUNTERS, self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        seen = list(self.state.get()) if self.state.exists() else [0] * len(STAGES)
        for frame in rows:
            for i, s in enumerate(STAGES):
                seen[i] += int((frame["stage"] == s).sum())
        self.state.update(tuple(seen))
        yield pd.DataFrame([(key[0], *seen)], columns=["job_id", *STAGES])

    def close(self) -> None:
        pass


def live_progress(events: DataFrame, ttl_seconds: int = PROGRESS_TTL) -> DataFrame:
    """[STR-8, AGG-2] A stream (job_id, fetched, processed, stored) from a stream (job_id, stage); the counters of a job are in RocksDB, which
    forgets them ``ttl_seconds`` after the job's last message, and can be read while the stream runs (``read_progress``)."""
    grouped = events.select("job_id", "stage").groupBy("job_id")
    return grouped.transformWithStateInPandas(Counters(ttl_seconds), f"job_id string, {COUNTERS}", "update", "processingTime")


def run_progress(progress: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``live_progress``; what it holds is read from its state. A query takes its settings from the session when it starts: this one
    needs RocksDB, as only that forgets state by itself, and no batches without news, which would never end where state has a life."""
    conf, own = progress.sparkSession.conf, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: conf.get(k) for k in own}
    try:
        for k, v in own.items():
            conf.set(k, v)
        writer = progress.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
    finally:
        for k, v in before.items():
            conf.set(k, v)


def read_progress(spark: SparkSession, checkpoint: str) -> DataFrame:
    """[STR-8, STR-10] (job_id, fetched, processed, stored) as the state of ``live_progress`` holds them now."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "counters").load()
    return state.select("key.job_id", *(F.col(f"value.value.{s}").alias(s) for s in STAGES))


def job_status(jobs: DataFrame, repos: DataFrame, job_id: str) -> DataFrame:
    """[SNK-6, Q6] What a status request gets: one row (event, status, progress, error); ``error`` says whether an id is malformed
    or unknown."""
    found = jobs.where(F.col("id") == job_id).select(F.col("status").alias("job_status"), "progress", "repo_id")
    named = found.join(repos.select(F.col("id").alias("repo_id"), "status"), "repo_id", "left")
    status = F.coalesce("status", "job_status")
    event = F.when(F.col("job_status").isNull(), "error").when(status.isin("completed", "failed"), "done").otherwise("update")
    one = jobs.sparkSession.range(1).select(F.lit(1).alias("one")).join(named.withColumn("one", F.lit(1)), "one", "left")
    error = F.when(event != "error", F.lit(None)).when(text.is_uuid(F.lit(job_id)), "unknown job").otherwise("malformed job id")
    return one.select(event.alias("event"), status.alias("status"), "progress", error.alias("error"))


def status_events(jobs: Callable[[], DataFrame], repos: Callable[[], DataFrame], job_id: str, wait: float = STATUS_POLL, polls: int = 10_000) -> Iterator[dict]:
    """[SNK-6] The events of one job as a client sees them: an update whenever its status or progress has changed, and at last
    done or error. ``jobs`` and ``repos`` give the tables as they are at each poll."""
    last = None
    for n in range(polls):
        now = job_status(jobs(), repos(), job_id).first().asDict()
        if now != last:
            yield now
        if now["event"] != "update":
            return
        last = now
        if n + 1 < polls:
            time.sleep(wait)
    raise TimeoutError(f"the job is not done after {polls} polls")

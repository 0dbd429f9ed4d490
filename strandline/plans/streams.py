"""Streaming queries over ``events``: the stream is read to its end and gives what the batch query gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators import relational
from strandline.plans import queries
from strandline.plans.registry import ORACLES, register
from strandline.schemas import PROCESS_MESSAGE
from strandline.sources import repositories
from strandline.sources.tables import KeptSums, MergedTable, PartitionedTable, append, file_key
from strandline.streaming import ingest, messages


#: How long a message about a file and stage may be repeated and still counts once.
REPEATS = "7 days"


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share; our own only where none is named and all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{shared or 'file:///tmp/checkpoints'}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(wanted).parquet(f"{sf_dir}/events.parquet*")


@register("stream_progress", ORACLES["job_progress"])
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[AGG-2, STR-9] Counters of jobs: each batch adds what is new in it to a table. Repeated messages are known again for as long
    as the watermark says, so the state is bounded by the messages of that time."""
    out = _folder(spark)
    m = queries.stage_messages(event_stream(spark, sf_dir))
    fresh = m.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", REPEATS).dropDuplicatesWithinWatermark(["job_id", "file_path", "stage"])

    def flush(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("job_id").pivot("stage", ["fetched", "processed", "stored"]).agg(F.count(F.lit(1)))
        totals = batch.groupBy("job_id").agg(F.max("total").alias("total_files"))
        counts.join(totals, "job_id").na.fill(0).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    q = fresh.writeStream.foreachBatch(flush).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    sums = [F.sum(s).alias(s) for s in ("fetched", "processed", "stored")]
    return relational.job_progress(spark.read.parquet(f"{out}/counts").groupBy("job_id").agg(*sums, F.max("total_files").alias("total_files")))


@register("stream_dead_letter", ORACLES["dead_letter_routing"])
def stream_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[STR-5, SNK-2] The routing of failures as a stateless stream into a table."""
    out = _folder(spark)
    routed = relational.route_failures(queries.failures(event_stream(spark, sf_dir)))
    q = routed.writeStream.format("parquet").option("path", f"{out}/routed").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(routed.schema).parquet(f"{out}/routed").select("event_id", "error", "route", "reason", "retries")


@register("stream_live_progress", "select user_id::varchar as job_id, count(*) filter (where event_type = 'view') as fetched, count(*) filter (where event_type = 'click') as processed, count(*) filter (where event_type = 'purchase') as stored from events group by user_id")
def stream_live_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[STR-8, STR-10] The same counters from keyed state with a time to live, as they are in the state store at the end."""
    out = _folder(spark)
    m = queries.stage_messages(event_stream(spark, sf_dir)).select(F.col("job_id").cast("string").alias("job_id"), "stage")
    messages.run_progress(messages.live_progress(m), f"{out}/checkpoint").awaitTermination()
    return messages.read_progress(spark, f"{out}/checkpoint")


@register(
    "fan_out_messages",
    "select source as repo_id, source || '-job' as job_id, source || '/' || doc_id as file_path, lang as language, 0 as retries from documents where source is not null",
)
def fan_out_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[STR-6] The fetch messages of all repositories become a message for each of their files."""
    files = queries.files(spark, sf_dir).withColumnRenamed("file_path", "path")
    repos = files.where("repo_id is not null").select("repo_id").distinct().select("repo_id", F.concat("repo_id", F.lit("-job")).alias("job_id"), F.lit("u").alias("repo_url"))
    return messages.fan_out(repos, files).select("repo_id", "job_id", "file_path", "language", "retries")


@register(
    "flushed_jobs",
    f"""with c as ({queries._COUNTS})
select c_custkey as id, coalesce(fetched, 0)::int as fetched_files, coalesce(processed, 0)::int as processed_files, coalesce(stored, 0)::int as stored_files,
  coalesce(trunc((fetched::double / 60) * 33 + (processed::double / 60) * 33 + (stored::double / 60) * 34)::int, 7) as progress
from customer left join c on c.job_id = c_custkey""",
)
def flushed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[STR-9, STR-10, Q13] Jobs of 60 files take over the counters of their messages; others stay as they are."""
    zero = {f"{s}_files": F.lit(0) for s in ("fetched", "processed", "stored")}
    jobs = queries.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).withColumns(zero | {"total_files": F.lit(60), "progress": F.lit(7)})
    counts = relational.stage_counts(queries.stage_messages(queries.table(spark, sf_dir, "events")))
    return messages.flush_progress(jobs, counts).drop("total_files")


@register(
    "dead_letters",
    f"""select '{{"event_id":"' || event_id || '","retries":"' || retries || '"}}' as payload, 'file:process' as stream_origin, error, reason
from ({queries.DEAD_LETTER_SQL}) where route = 'dead_letter'""",
)
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[SNK-2] What cannot be tried again, with where it came from and why."""
    routed = relational.route_failures(queries.failed_messages(spark, sf_dir)).where("route = 'dead_letter'")
    return messages.dead_letters(routed, "file:process").drop("failed_at")


@register(
    "job_status",
    "select case when o_orderstatus = 'F' then 'done' else 'update' end as event, case when o_orderstatus = 'F' then 'completed' else 'processing' end as status, (o_orderkey % 100)::int as progress, null::varchar as error from orders where o_orderkey = 11",
)
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[SNK-6, Q6] What a poll of one job's status gets."""
    state = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("processing")
    jobs = queries.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("repo_id"), state.alias("status"), (F.col("o_orderkey") % 100).cast("int").alias("progress"))
    repos = jobs.select(F.col("repo_id").alias("id"), "status").where("false")
    return messages.job_status(jobs, repos, "11")


@register(
    "stream_retries",
    """select c_custkey as id, case when c_custkey % 11 = 0 then 1 when c_custkey % 7 = 0 then 4 when c_custkey % 5 = 0 then 3 else 1 end::bigint as attempts,
  case when c_custkey % 11 = 0 then 'quota_hit' when c_custkey % 7 = 0 then 'Max retries reached' end as reason from customer""",
)
def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[STR-4, STR-5, SRC-7, SRC-8, SNK-1, SNK-2] A message for each customer goes through an inbox until it is done or a dead letter:
    some hit a quota, some fail twice, some at every attempt."""
    out = _folder(spark)
    fields = "id long, retries int"
    messages.publish(queries.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.lit(0).alias("retries")), f"{out}/inbox")

    def work(batch: DataFrame, number: int) -> DataFrame:
        batch.select("id").write.mode("overwrite").parquet(f"{out}/attempts/batch={number}")
        fails = F.when(F.col("id") % 11 == 0, "Quota exceeded").when(F.col("id") % 7 == 0, "timed out").when((F.col("id") % 5 == 0) & (F.col("retries") < 2), "timed out")
        return batch.withColumn("error", fails).where("error is not null")

    def start() -> StreamingQuery:
        stream = messages.read_messages(spark, f"{out}/inbox", fields, files_per_poll=1000)
        return messages.process(stream, work, f"{out}/inbox", f"{out}/dead", f"{out}/checkpoint", "file:process")

    messages.drain(start)
    tried = spark.read.parquet(f"{out}/attempts").groupBy("id").agg(F.count(F.lit(1)).alias("attempts"))
    letters = spark.read.option("recursiveFileLookup", True).parquet(f"{out}/dead")
    gone = letters.select(F.get_json_object("payload", "$.id").cast("long").alias("id"), "reason")
    return tried.join(gone, "id", "left").select("id", "attempts", "reason")


@register(
    "over_limits",
    """with r as (select case event_type when 'view' then 'ingest' when 'click' then 'login' when 'purchase' then 'register' else 'other' end as endpoint,
  case when event_id % 3 = 0 then 'ip' || (user_id % 5) else user_id::varchar end as client, date_trunc('month', ts) as minute from events)
select endpoint, client, minute, count(*) as n from r where endpoint <> 'other' group by 1, 2, 3
having count(*) > case endpoint when 'ingest' then 10 when 'login' then 5 else 3 end""",
)
def over_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[CTL-1] Clients over an endpoint's limit; a minute here is a month of the events."""
    of = {"view": "ingest", "click": "login", "purchase": "register"}
    endpoint = F.coalesce(F.create_map(*(F.lit(x) for kv in of.items() for x in kv))[F.col("event_type")], F.lit("other"))
    known = F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string"))
    address = F.concat(F.lit("ip"), (F.col("user_id") % 5).cast("string"))
    e = queries.table(spark, sf_dir, "events")
    requests = e.select(endpoint.alias("endpoint"), known.alias("subject"), address.alias("address"), F.date_trunc("month", "ts").alias("ts"))
    return relational.over_limits(requests).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@register("history_append", ORACLES["history_pairs"])
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[SNK-5] Questions with their answers, appended to a history in two batches."""
    out, pairs = _folder(spark), queries.history_pairs(spark, sf_dir)
    for half in (0, 1):
        append(pairs.where(F.col("conv_id") % 2 == half), f"{out}/history")
    return spark.read.schema(pairs.schema).parquet(f"{out}/history")


@register(
    "replaced_partitions",
    "select label::varchar as repo_id, case when label % 3 = 1 then -vec_id else vec_id end::bigint as point_id from embeddings where label % 3 <> 2 or label is null",
)
def replaced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[SNK-3, SNK-4, DEL-1, DEL-3] Points partitioned by repository: some repositories are replaced, some dropped, the others not touched."""
    points = PartitionedTable(spark, f"{_folder(spark)}/points", "repo_id string, point_id long", by=["repo_id"], lookup=["point_id"])
    rows = queries.table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("repo_id"), F.col("vec_id").cast("long").alias("point_id"))
    points.append(rows)
    group = F.col("repo_id").cast("int") % 3
    old = points.read().where(group == 1)
    points.replace_partitions(old.withColumn("point_id", -F.col("point_id")), rows.where(group == 1))
    points.drop_partitions(rows.where(group == 2))
    return points.read().select("repo_id", "point_id")


_SUFFIXES = (".py", ".js", ".java", ".md", "", ".PY", ".go")
_FILE_SQL = f"doc_id % 5 || '/' || doc_id || {queries.choice_sql('doc_id % 7', _SUFFIXES)}"


def checked_out(spark: SparkSession, sf_dir: str) -> str:
    """A folder of repositories with a file for each document: by id, some of no known language, some that are no UTF-8. Each repository
    has a second one beside it that holds notes only."""
    root, n = _folder(spark), F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (n % 7 + 1).cast("int"))
    body = F.encode("text", "utf-8")
    content = F.when(n % 4 == 3, F.concat(body, F.unhex(F.lit("C328FF")))).otherwise(body)
    docs = queries.table(spark, sf_dir, "documents").where("text is not null and source is not null")
    files = docs.select("source", F.concat((n % 5).cast("string"), F.lit("/"), n.cast("string"), suffix).alias("path"), content.alias("content"))
    notes = docs.groupBy("source").agg(F.min("doc_id").alias("doc_id")).select(F.concat("source", F.lit("-notes")).alias("source"), F.concat("doc_id", F.lit(".md")).alias("path"), F.encode(F.lit("n"), "utf-8").alias("content"))
    repositories.write_files(files.unionByName(notes), root)
    return root


@register(
    "repository_files",
    f"select source as repo_id, {_FILE_SQL} as path, {queries.choice_sql('doc_id % 7', ('py', 'js', 'java', None, None, None, 'go'))} as language, sha256({queries.norm_sql('text')}) as file_hash from documents where text is not null and source is not null and doc_id % 4 <> 3 and doc_id % 7 not in (3, 4, 5)",
)
def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[SRC-1, SRC-2, FLT-1] All documents as files of repositories, read back by the source that opens what it keeps."""
    return repositories.source_files(spark, checked_out(spark, sf_dir)).where("error is null").select("repo_id", "path", "language", "file_hash")


@register(
    "fetched_repositories",
    f"""with s as (select source, count(*) filter (doc_id % 4 <> 3 and doc_id % 7 not in (3, 4, 5))::int as n from documents where text is not null and source is not null group by source),
r as (select source as repo_id, n, case when n = 0 then '{ingest.NO_FILES}' end as error from s
  union all select source || '-notes', 0, '{ingest.NO_FILES}' from s union all select source || '-gone', 0, 'no such repository' from s)
select repo_id, case when error is null then 'processing' else 'failed' end as status, n as total_files, coalesce(error, '') as error, n as messages from r""",
)
def fetched_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[STR-6, SRC-1, AGG-6] All repositories are fetched; those without source files, and those that are not there, have failed."""
    root, out = checked_out(spark, sf_dir), _folder(spark)
    names = queries.table(spark, sf_dir, "documents").where("text is not null and source is not null").select("source").distinct()
    repo = names.select(F.explode(F.array("source", *(F.concat("source", F.lit(x)) for x in ("-notes", "-gone")))).alias("repo_id"))
    wanted = repo.select("repo_id", F.concat("repo_id", F.lit("-job")).alias("job_id"), F.lit("u").alias("repo_url"), F.lit(0).alias("retries"))
    fetched = ingest.fetch(spark, wanted, root, f"{out}/inbox")
    jobs = wanted.select(F.col("job_id").alias("id"), F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(0).alias("total_files"))
    repos = wanted.select(F.col("repo_id").alias("id"), F.lit("fetching").alias("status"), F.lit(None).cast("string").alias("error_message"))
    jobs, repos = ingest.fetched_states(jobs, repos, fetched)
    sent = spark.read.schema(PROCESS_MESSAGE).json(f"{out}/inbox").groupBy("repo_id").agg(F.count(F.lit(1)).cast("int").alias("messages"))
    both = repos.select(F.col("id").alias("repo_id"), "status", F.col("error_message").alias("error")).join(jobs.select(F.regexp_replace("id", "-job$", "").alias("repo_id"), "total_files", F.col("status").alias("job_status")), "repo_id")
    return both.where("status = job_status").join(sent, "repo_id", "left").select("repo_id", "status", "total_files", "error", F.coalesce("messages", F.lit(0)).alias("messages"))


@register(
    "merged_upserts",
    """with p as (select label::varchar as repo_id, 'f' || (vec_id % 20) as file, vec_id, label % 2 = 0 and vec_id % 20 in (3, 7) as met from embeddings where label is not null)
select repo_id, file, vec_id as point_id from p where file <> 'f9' and not met union all select repo_id, file, vec_id + 1000000 from p where met and vec_id % 3 = 0""",
)
def merged_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[UPS-1, SNK-3, DEL-2] Points of files in three batches that only add rows: all, the files of some repositories anew, a file removed."""
    e = queries.table(spark, sf_dir, "embeddings").where("label is not null")
    repo, file = F.col("label").cast("string"), F.concat(F.lit("f"), (F.col("vec_id") % 20).cast("string"))
    rows = e.select(repo.alias("repo_id"), file.alias("file"), F.col("vec_id").alias("point_id"), "label").withColumn("key", file_key(F.col("repo_id"), F.col("file")))
    table = MergedTable(spark, f"{_folder(spark)}/points", "key string, repo_id string, file string, point_id long", "repo_id", "key")
    table.add(rows.drop("label"), 1)
    met = rows.where("label % 2 = 0 and file in ('f3', 'f7')").drop("label")
    anew = met.where("point_id % 3 = 0").withColumn("point_id", F.col("point_id") + 1000000)
    table.add(anew, 2, forget=met.join(anew.select("key").distinct(), "key", "left_anti"))
    table.add(rows.drop("label").where("false"), 3, forget=rows.where("file = 'f9'"))
    return table.read().drop("key")


@register(
    "kept_sums",
    """with d as (select source as repo_id, doc_id, coalesce(n_chars, 0) as n from documents where source is not null),
s as (select repo_id, case when doc_id % 4 = 0 then n + 7 else n end as n from d where doc_id % 10 <> 0 union all select repo_id, n + 1 from d where doc_id % 9 = 0)
select r.repo_id, count(s.n) as n, coalesce(sum(s.n), 0)::bigint as chunks_indexed from (select distinct repo_id from d) r left join s using (repo_id) group by r.repo_id""",
)
def kept_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[AGG-1, UPS-3] The sums of repositories, kept through batches that add, replace and remove files; no batch reads what it doesn't meet."""
    docs, out = queries.table(spark, sf_dir, "documents").where("source is not null"), _folder(spark)
    rows = docs.select(F.col("source").alias("repo_id"), "doc_id", F.col("doc_id").cast("string").alias("path"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("chunks_indexed"))
    more = lambda n: F.col("chunks_indexed") + n
    new = rows.where("doc_id % 9 = 0").withColumns({"path": F.concat("path", F.lit("x")), "chunks_indexed": more(1)})
    batches = [(rows, None), (rows.where("doc_id % 4 = 0").withColumn("chunks_indexed", more(7)).unionByName(new), None), (rows.where("false"), rows.where("doc_id % 10 = 0"))]
    table = MergedTable(spark, f"{out}/files", "key string, repo_id string, chunks_indexed long", "repo_id", "key")
    sums = KeptSums(table, f"{out}/sums", ["chunks_indexed"])
    keyed = lambda df: None if df is None else df.select("repo_id", file_key(F.col("repo_id"), F.col("path")).alias("key"), "chunks_indexed")
    for version, (batch, gone) in enumerate(batches, 1):
        batch, gone = keyed(batch), keyed(gone)
        met = batch.select("repo_id") if gone is None else gone.select("repo_id")
        met = [r.repo_id for r in met.distinct().collect()]  # repositories
        sums.add(batch, met, version, gone)
        table.add(batch, version, gone)
    return sums.read()


_ACKED = "ts + to_seconds(event_id % 600)"


@register(
    "reclaimed_messages",
    f"""with t as (select event_id as message_id, ts as taken_at from events where event_type <> 'error'),
a as (select event_id, {_ACKED} as acked_at from events where event_type <> 'error' and event_id % 4 <> 0),
w as (select least((select max(taken_at) from t), (select max(acked_at) from a)) - interval 10 minute as mark)
select message_id, taken_at from t, w where taken_at + interval {messages.IDLE_SECONDS} second < mark
  and not exists (select 1 from a where a.event_id = message_id and acked_at between taken_at and taken_at + interval {messages.IDLE_SECONDS} second)""",
)
def reclaimed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[STR-3] Every event but errors is a message; three of four are acknowledged, some too late. Those whose time was over when the stream
    ended, by its watermarks, come out."""
    out = _folder(spark)
    events = lambda: event_stream(spark, sf_dir).where("event_type <> 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    taken = events().select(F.col("event_id").alias("message_id"), F.col("ts").alias("taken_at"))
    late = F.make_dt_interval(secs=F.col("event_id") % 600)
    acks = events().where("event_id % 4 <> 0").select(F.col("event_id").alias("message_id"), (F.col("ts") + late).alias("acked_at"))
    left = messages.unacknowledged(taken, acks)
    q = left.writeStream.format("parquet").option("path", f"{out}/left").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(left.schema).parquet(f"{out}/left").withColumn("taken_at", F.col("taken_at").cast("timestamp_ntz"))


@register("malformed_messages", "select event_id as id, case when event_id % 7 = 0 then 'malformed payload' end as error, case when event_id % 7 = 0 then 'malformed' else 'done' end as state from events")
def malformed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[STR-12, STR-7, SRC-7] A message for each event, some cut off in the middle: these are dead letters at once, the others are done, in
    batches of a few files."""
    out = _folder(spark)
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.lit(0).alias("retries")))
    cut = F.when(F.col("event_id") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 4)).otherwise(line)
    queries.table(spark, sf_dir, "events").select(cut.alias("value")).repartition(6).write.text(f"{out}/inbox")

    def work(batch: DataFrame, number: int) -> DataFrame:
        batch.select("id").write.mode("overwrite").parquet(f"{out}/done/batch={number}")
        return batch.where("false").withColumn("error", F.lit(""))

    stream = messages.read_messages(spark, f"{out}/inbox", "id long, retries int", files_per_poll=2)
    messages.process(stream, work, f"{out}/inbox", f"{out}/dead", f"{out}/checkpoint", "file:process").awaitTermination()
    letters = spark.read.option("recursiveFileLookup", True).schema("payload string, error string, reason string").parquet(f"{out}/dead")
    bad = letters.select(F.regexp_extract("payload", '"id":([0-9]+)', 1).cast("long").alias("id"), "error", F.col("reason").alias("state"))
    return bad.unionByName(spark.read.parquet(f"{out}/done").select("id", F.lit(None).cast("string").alias("error"), F.lit("done").alias("state")))


_ENDPOINTS = {"view": "ingest", "click": "login", "purchase": "register"}


@register(
    "stream_rate_limits",
    """with r as (select case event_type when 'view' then 'ingest' when 'click' then 'login' else 'register' end as endpoint, case when event_id % 3 = 0 then 'ip' || (user_id % 5) else (user_id % 20)::varchar end as client,
  make_timestamp((epoch(ts)::bigint // 2000) * 1000000) as t, case when event_id % 50 = 0 then 2 else event_id % 2 end as part from events where event_type in ('view', 'click', 'purchase')),
w as (select max(t) - interval 10 minute as mark from r where part = 0),
k as (select *, date_trunc('minute', t) as minute, part < 2 or date_trunc('minute', t) + interval 1 minute > mark as counted from r, w)
select endpoint, client, minute, count(*) as n from k where counted group by all having count(*) > case endpoint when 'ingest' then 10 when 'login' then 5 else 3 end
union all select endpoint, client, null, count(*) from k where not counted group by all""",
)
def stream_rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[CTL-1] Requests, which are the events at 2,000 times their pace, in real minutes; every fiftieth comes after all others. Clients over a
    limit, and, without a minute, how many requests of a client came too late to count."""
    out, e = _folder(spark), queries.table(spark, sf_dir, "events")
    endpoint = F.create_map(*(F.lit(x) for kv in _ENDPOINTS.items() for x in kv))[F.col("event_type")]
    known = F.when(F.col("event_id") % 3 != 0, (F.col("user_id") % 20).cast("string"))
    second = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")  # the nearest, as the SQL's cast takes it
    at = F.timestamp_seconds(F.floor(second / 2000))
    requests = e.select(endpoint.alias("endpoint"), known.alias("subject"), F.concat(F.lit("ip"), (F.col("user_id") % 5).cast("string")).alias("address"), at.alias("ts"), F.when(F.col("event_id") % 50 == 0, 2).otherwise(F.col("event_id") % 2).alias("part")).where("endpoint is not null")
    for part in range(3):  # what is late is known by the watermark of the batch before
        requests.where(F.col("part") == part).repartition(4).write.mode("append").parquet(f"{out}/requests")
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 4).parquet(f"{out}/requests")
    messages.run_limits(stream, f"{out}/counts", f"{out}/checkpoint").awaitTermination()
    counts, over = messages.read_limits(spark, f"{out}/counts")
    client = F.coalesce("subject", "address").alias("client")
    sent = requests.groupBy("endpoint", client).agg(F.count(F.lit(1)).alias("sent"))
    late = sent.join(counts.groupBy("endpoint", "client").agg(F.sum("n").alias("counted")), ["endpoint", "client"], "left").withColumn("n", F.col("sent") - F.coalesce("counted", F.lit(0)))
    return over.withColumn("minute", F.col("minute").cast("timestamp_ntz")).unionByName(late.where("n > 0").select("endpoint", "client", F.lit(None).cast("timestamp_ntz").alias("minute"), "n"))

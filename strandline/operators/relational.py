"""

Nothing here is collected; small sides are left to Spark's own size estimate, so a side is broadcast only when its size is
known to be small. Keys are joined by equality, so every join can be split where a key is skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import text


# -- filters ---------------------------------------------------------------------------------------------------------


def known_files(files: DataFrame, path: str = "path") -> DataFrame:
    """[FLT-1] Files whose suffix names a language, with that language."""
    return files.withColumn("language", text.language(F.col(path))).where("language is not null")


def changed_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """[FLT-3, JOIN-4] Files (repo_id, file_path, file_hash, ...) that are new, changed or not completed."""
    done = stored.where(F.col("status") == "completed").select("repo_id", "file_path", "file_hash")
    return files.join(done, ["repo_id", "file_path", "file_hash"], "left_anti")


#: Bits of a block of the filter (the size of Spark's bitmaps), blocks at most (16 MB in all), bits that a key sets, and keys of a block.
BLOCK_BITS, MAX_BLOCKS, KEY_BITS, BLOCK_KEYS = 32_768, 4096, 4, 3000


def _bits(key: Column) -> Column:
    """A key's bits in its block: two halves of a hash, stepped."""
    one, two = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(BLOCK_BITS)), F.pmod(F.xxhash64(key, F.lit(2)), F.lit(BLOCK_BITS // 2)) * 2 + 1
    return F.array(*((one + i * two) % BLOCK_BITS for i in range(KEY_BITS)))


def changed_files_filtered(files: DataFrame, stored: DataFrame, blocks: int | None = None) -> DataFrame:
    """[FLT-3, JOIN-4] The rows of ``changed_files``, for stored tables that know few of the files: a Bloom filter over the stored keys says of
    a file that it is surely new, and such files take no part in a shuffle; the others are joined.

    The filter is a bitmap for each of ``blocks`` blocks, broadcast: ``BLOCK_KEYS`` keys a block, 16 MB at most, however many keys there are. A
    full filter lets more files through to the join and skips none wrongly. Null keys are never stored, so such files are new.
    """
    names = ["repo_id", "file_path", "file_hash"]
    key = F.when(F.col("repo_id").isNotNull() & F.col("file_path").isNotNull() & F.col("file_hash").isNotNull(), F.xxhash64(*names))
    done = stored.where(F.col("status") == "completed").select(*names)
    n = blocks or min(MAX_BLOCKS, -(-done.count() // BLOCK_KEYS) or 1)
    block = F.pmod(key, F.lit(n)).cast("int")
    set_bits = done.select(block.alias("__block"), F.explode(_bits(key)).alias("bit")).where("__block is not null")
    bitmaps = set_bits.groupBy("__block").agg(F.bitmap_construct_agg("bit").alias("__bitmap"))
    asked = files.withColumn("__block", block).join(F.broadcast(bitmaps), "__block", "left")
    byte = lambda p: F.conv(F.hex(F.substring("__bitmap", (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = lambda p: F.call_function("getbit", byte(p), (p % 8).cast("int")) == 1
    known = F.coalesce(F.col("__bitmap").isNotNull() & F.forall(_bits(key), is_set), F.lit(False))
    split = asked.withColumn("__known", known)
    maybe = split.where("__known").select(*files.columns).join(done, names, "left_anti").select(*files.columns)
    return split.where("not __known").select(*files.columns).unionByName(maybe)


def open_repos(messages: DataFrame, repos: DataFrame) -> DataFrame:
    """[FLT-4] Messages of repositories that are not completed."""
    return messages.join(repos.where("status = 'completed'").select(F.col("id").alias("repo_id")), "repo_id", "left_anti")


def in_states(df: DataFrame, states: Sequence[str], status: str = "status") -> DataFrame:
    """[FLT-5]"""
    return df.where(F.col(status).isin(*states))


def unexpired(tokens: DataFrame, now: Column | None = None) -> DataFrame:
    """[FLT-7]"""
    return tokens.where(F.col("expires_at") > (F.current_timestamp() if now is None else now))


# -- joins -----------------------------------------------------------------------------------------------------------


def with_repo_and_job(messages: DataFrame, repos: DataFrame, jobs: DataFrame) -> DataFrame:
    """[JOIN-1] Messages (repo_id, job_id) with their repository and job; those without one or the other are left out."""
    r = repos.select(F.col("id").alias("repo_id"), F.col("status").alias("repo_status"))
    j = jobs.select(F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    return messages.join(r, "repo_id").join(j, "job_id")


def orphans(messages: DataFrame, repos: DataFrame, jobs: DataFrame) -> DataFrame:
    """[JOIN-1] The messages that ``with_repo_and_job`` leaves out."""
    r = repos.select(F.col("id").alias("repo_id"))
    j = jobs.select(F.col("id").alias("job_id"))
    missing = messages.join(r, "repo_id", "left_anti")
    return missing.unionByName(messages.join(r, "repo_id", "left_semi").join(j, "job_id", "left_anti"))


def jobs_with_repo(jobs: DataFrame, repos: DataFrame) -> DataFrame:
    """[JOIN-2] Every job, with its repository where there is one."""
    r = repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo_name"), F.col("status").alias("repo_status"))
    return jobs.join(r, "repo_id", "left")


def not_present(new: DataFrame, old: DataFrame, key: Sequence[str]) -> DataFrame:
    """[INS-1, JOIN-3] One row for each key of ``new`` that ``old`` lacks: what an insert-if-absent appends."""
    return new.dropDuplicates(list(key)).join(old.select(*key).distinct(), list(key), "left_anti")


def registration_conflicts(new: DataFrame, users: DataFrame) -> DataFrame:
    """[INS-1, Q17] Registrations with ``conflict``: email first, then username, null where the user may be added."""
    by = {c: users.select(F.col(c), F.lit(True).alias(f"has_{c}")).distinct() for c in ("email", "username")}
    found = new.join(by["email"], "email", "left").join(by["username"], "username", "left")
    conflict = F.when(F.col("has_email"), "email").when(F.col("has_username"), "username")
    return found.withColumn("conflict", conflict).drop("has_email", "has_username")


def chunks_with_metadata(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """[JOIN-7] Chunks with the summary and skeleton of their file."""
    m = metadata.select("repo_id", F.col("file_path").alias("file"), "summary", "skeleton")
    return chunks.join(m, ["repo_id", "file"])


# -- aggregates ------------------------------------------------------------------------------------------------------


def chunks_per_repo(repos: DataFrame, metadata: DataFrame) -> DataFrame:
    """[AGG-1] Every repository with the chunks of its files, 0 without any."""
    sums = metadata.groupBy("repo_id").agg(F.sum("chunks_indexed").alias("chunks_indexed"))
    return repos.select(F.col("id").alias("repo_id")).join(sums, "repo_id", "left").withColumn("chunks_indexed", F.coalesce("chunks_indexed", F.lit(0)).cast("long"))


def stage_counts(messages: DataFrame, stages: Sequence[str] = ("fetched", "processed", "stored")) -> DataFrame:
    """[AGG-2] Files of each job (job_id, file_path, stage) by stage. A file counts once per stage however often it is retried."""
    once = [F.count_distinct(F.when(F.col("stage") == s, F.col("file_path"))).alias(s) for s in stages]
    return messages.groupBy("job_id").agg(*once)


def job_progress(counts: DataFrame, total: str = "total_files") -> DataFrame:
    """[AGG-3, AGG-4, STR-10] Adds ``progress`` and ``status`` to (total, fetched, processed, stored)."""
    shown = text.progress(F.col("fetched"), F.col("processed"), F.col("stored"), F.col(total))
    status = F.when((F.col("stored") >= F.col(total)) & (F.col(total) > 0), "completed").otherwise("processing")
    return counts.withColumns({"progress": shown, "status": status})


def ordered_text(df: DataFrame, by: Sequence[str], order: str, value: Column, separator: str, name: str) -> DataFrame:
    """[AGG-7] Joins a text column in order, for groups whose texts together are one value (a prompt, a skeleton)."""
    return ordered_list(df, by, order, value, "__list").select(*by, F.array_join("__list", separator).alias(name))


def ordered_list(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """[AGG-8] Collects values in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(*by).agg(F.transform(listed, lambda x: x["v"]).alias(name))


# -- windows ---------------------------------------------------------------------------------------------------------


def latest(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """[WIN-1, SRT-1] The first row of each key by ``order``."""
    return newest(df, key, 1, *order)


def newest(df: DataFrame, key: Sequence[str], n: int, *order: Column) -> DataFrame:
    """[WIN-2, SRT-2] The first n rows of each key by ``order``; Spark cuts each task's groups to n before the shuffle."""
    nth = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth")


def over_limit(events: DataFrame, key: str, ts: str, per_minute: int) -> DataFrame:
    """[CTL-1] Keys and minutes with more than ``per_minute`` requests."""
    minute = F.date_trunc("minute", F.col(ts))
    return events.groupBy(F.col(key), minute.alias("minute")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_minute)


#: Requests a minute by endpoint.
LIMITS = {"ingest": 10, "register": 3, "login": 5, "refresh": 5, "logout": 5}


def over_limits(requests: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """[CTL-1] (endpoint, client, minute, n): who was over the endpoint's limit in a minute, of requests (endpoint, subject, address,
    ts). A client is known by the token's subject, else by the address; endpoints without a limit are left out."""
    limit = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col("endpoint")]
    minute = F.date_trunc("minute", F.col("ts")).alias("minute")
    counted = requests.where(limit.isNotNull()).groupBy("endpoint", F.coalesce("subject", "address").alias("client"), minute).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > limit)


# -- routing ---------------------------------------------------------------------------------------------------------


def route_failures(failed: DataFrame, max_retries: int = 3, strict: bool = False) -> DataFrame:
    """[STR-4, STR-5, SCL-19, LIM-1] Adds ``route``, ``reason``, ``retries`` (of the next attempt) and the error's first 200 characters.

    A quota or rate error goes to the dead letter at once, any other is tried again up to ``max_retries`` times. The loose
    test of the message also takes words like "generate"; ``strict`` uses the exact one.
    """
    quota = (text.is_rate_limit if strict else text.is_quota_hit)(F.col("error"))
    again = ~quota & (F.col("retries") < max_retries)
    return failed.withColumns(
        {
            "route": F.when(again, "retry").otherwise("dead_letter"),
            "reason": F.when(quota, "quota_hit").when(~again, "Max retries reached"),
            "retries": F.when(again, F.col("retries") + 1).otherwise(F.col("retries")).cast("int"),
            "error": text.truncate_error(F.lower("error")),
        }
    )

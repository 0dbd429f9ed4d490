"""Streams in trouble: outages, batches that died, messages that nobody acknowledged."""

import json
import time
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandline.plans import streams
from strandline.plans.registry import ORACLES
from strandline.streaming import messages
from tests.conftest import oracle, rows


def start(spark, tmp_path, work):
    return messages.process(messages.read_messages(spark, str(tmp_path / "inbox"), "i int, retries int"), work, str(tmp_path / "inbox"), str(tmp_path / "dead"), str(tmp_path / "cp"), "x:y")


def letters(spark, tmp_path):
    return spark.read.option("recursiveFileLookup", True).schema("payload string, error string, reason string").parquet(str(tmp_path / "dead")).collect()


def put(tmp_path, n):
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox/m.json").write_text("\n".join(json.dumps({"i": i, "retries": 0}) for i in range(n)))


def test_an_outage_blames_no_message(spark, tmp_path):
    """Storage is down for a batch: the query ends, and when it is started again all messages are done."""
    put(tmp_path, 9)
    down, done = [True], set()

    def work(batch, number):
        if down[0] and not batch.isEmpty():
            raise OSError("storage is down")
        done.update(r.i for r in batch.collect())
        return batch.where("false").withColumn("error", F.lit(""))

    with pytest.raises(Exception, match="storage is down"):
        start(spark, tmp_path, work).awaitTermination()
    assert not done and not list((tmp_path / "inbox").glob("retry*")) and not list((tmp_path / "dead").glob("x-y*"))
    down[0] = False
    messages.drain(lambda: start(spark, tmp_path, work))
    assert done == set(range(9)) and letters(spark, tmp_path) == []


def test_what_looks_like_an_outage_too_often_is_the_messages(spark, tmp_path):
    put(tmp_path, 2)

    def work(batch, number):
        if not batch.isEmpty():
            raise ValueError("no such column")
        return batch.where("false").withColumn("error", F.lit(""))

    for _ in range(messages.OUTAGES):
        with pytest.raises(Exception, match="no such column"):
            start(spark, tmp_path, work).awaitTermination()
    ends = 0
    while True:  # each new batch of retries has its own outages
        try:
            messages.drain(lambda: start(spark, tmp_path, work))
            break
        except Exception as e:
            assert "no such column" in str(e)
            ends += 1
    assert ends == 3 * messages.OUTAGES and {r.error for r in letters(spark, tmp_path)} == {"no such column"} and len(letters(spark, tmp_path)) == 2


def test_a_batch_that_died_is_replayed(spark, tmp_path, monkeypatch):
    """[STR-3] The driver goes after the work and before the batch is settled: the same messages come again, with the same number."""
    put(tmp_path, 5)
    seen = []

    def work(batch, number):
        seen.append((number, sorted(r.i for r in batch.collect())))
        return batch.where("i = 3").withColumn("error", F.lit("quota exceeded"))

    settle = messages.settle

    def dies(*args):
        monkeypatch.setattr(messages, "settle", settle)
        raise RuntimeError("driver lost")

    monkeypatch.setattr(messages, "settle", dies)
    with pytest.raises(Exception, match="driver lost"):
        start(spark, tmp_path, work).awaitTermination()
    messages.drain(lambda: start(spark, tmp_path, work))
    assert seen[0] == seen[1] == (0, [0, 1, 2, 3, 4])
    assert [(json.loads(r.payload)["i"], r.reason) for r in letters(spark, tmp_path)] == [("3", "quota_hit")]


def test_drain_does_not_end_unfinished(spark, tmp_path):
    put(tmp_path, 1)
    with pytest.raises(TimeoutError):
        messages.drain(lambda: start(spark, tmp_path, lambda b, n: b.withColumn("error", F.lit("timed out"))), rounds=2)


def test_messages_come_out_once_and_state_is_let_go(spark, tmp_path):
    rows = lambda name, *data: spark.createDataFrame([(i, s) for i, s in data], "message_id long, at long").selectExpr("message_id", f"timestamp_seconds(at) as {name}")
    steps = [([(1, 0), (2, 10), (3, 20)], [(1, 200), (2, 400)]), ([(9, 5000)], [(9, 5001)]), ([(10, 9000)], [(10, 9001)])]
    got, rows_kept = [], []
    for taken, acked in steps:
        rows("taken_at", *taken).coalesce(1).write.mode("append").parquet(f"{tmp_path}/taken")
        rows("acked_at", *acked).coalesce(1).write.mode("append").parquet(f"{tmp_path}/acks")
        t = spark.readStream.schema("message_id long, taken_at timestamp").parquet(f"{tmp_path}/taken")
        a = spark.readStream.schema("message_id long, acked_at timestamp").parquet(f"{tmp_path}/acks")
        q = messages.unacknowledged(t, a).writeStream.foreachBatch(lambda b, n: got.extend(r.message_id for r in b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        rows_kept.append(q.lastProgress.stateOperators[0].numRowsTotal)
    assert sorted(got) == [2, 3] and rows_kept[-1] <= 4


def test_progress_is_forgotten(spark, tmp_path):
    """[STR-8] A job without messages for the time to live starts anew; its state can be read between batches."""
    seen = []
    for n, stages in enumerate((["fetched", "fetched", "stored"], ["processed"])):
        spark.createDataFrame([("j", s) for s in stages], "job_id string, stage string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/m")
        m = spark.readStream.schema("job_id string, stage string").parquet(f"{tmp_path}/m")
        messages.run_progress(messages.live_progress(m, ttl_seconds=3), f"{tmp_path}/cp").awaitTermination(60)
        seen.append([tuple(r) for r in messages.read_progress(spark, f"{tmp_path}/cp").collect()])
        time.sleep(0 if n else 5)
    assert seen == [[("j", 2, 0, 1)], [("j", 0, 1, 0)]]


def test_requests_are_of_the_nearest_second(spark, tmp_path):
    """The SQL's cast rounds; 119,999.6 seconds of events are 120,000, the first second of a minute at 2,000 times the pace."""
    at = lambda s: datetime(1970, 1, 1) + timedelta(seconds=s)
    events = [(i, at(s), 1, "view") for i, s in enumerate([119_999.6] * 12 + [119_999.4] * 14 + [119_998.5] * 15 + [200_000.0] * 16) if i % 50]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "events"))
    pq.write_table(pq.read_table(tmp_path / "events"), tmp_path / "events.parquet")  # one file, as the SQL reads it
    got = rows(streams.stream_rate_limits(spark, str(tmp_path)))
    assert got == oracle("", ORACLES["stream_rate_limits"], str(tmp_path))

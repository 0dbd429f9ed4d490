"""Queries that have to look at all of a table and at whole texts."""

from strandline.plans import queries, streams  # noqa: F401
from strandline.plans.registry import ORACLES, QUERIES
from tests.conftest import SF, oracle, rows


def test_prompt_context_has_whole_texts(spark, tmp_path):
    docs = [(1, "a", "x" * 40 + " one", 44), (2, "a", "x" * 40 + " two", 44)]
    for name, text in (("one", docs), ("two", [(i, s, t[:40] + " other", n) for i, s, t, n in docs])):
        spark.createDataFrame(text, "doc_id long, source string, text string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    one, two = (QUERIES["prompt_context"](spark, f"{tmp_path}/{n}").collect() for n in ("one", "two"))
    assert len(one) == 1 and one != two  # they differ after the 40th character only
    larger = SF.replace("0.001", "0.01")
    assert rows(QUERIES["prompt_context"](spark, larger)) == oracle("", ORACLES["prompt_context"], larger)


def test_messages_of_all_sources(spark, tmp_path):
    docs = [(1, "src1", "de", "a"), (2, "other", "en", "b"), (3, "other", "en", "c"), (4, None, "en", "d")]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["fan_out_messages"](spark, str(tmp_path)).select("repo_id", "job_id", "file_path").collect()
    assert sorted(map(tuple, got)) == [("other", "other-job", "other/2"), ("other", "other-job", "other/3"), ("src1", "src1-job", "src1/1")]


def test_registrations_meet_all_customers(spark, tmp_path):
    spark.createDataFrame([(i, f"s{i}") for i in (1, 2, 3, 4)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(20, "a"), (40, "b"), (14_980, "s3"), (15_000, "c")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = dict(map(tuple, QUERIES["registration_conflicts"](spark, str(tmp_path)).collect()))
    assert got == {1: "email", 2: "email", 3: "username", 4: None}
    larger = SF.replace("0.001", "0.1")
    found = rows(QUERIES["registration_conflicts"](spark, larger))
    assert found == oracle("", ORACLES["registration_conflicts"], larger)
    print({c: sum(repr(c) in r for r in found[1]) for c in ("email", "username", None)})

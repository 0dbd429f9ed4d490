from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing as M
from strandline.llm.queries import QUERIES, contract_targets
from tests.conftest import SF


def test_targets_share_everything_and_stop_at_the_cap():
    sizes = {"a": 10, "b": 1000, "c": 20, None: 5}
    t = contract_targets(sizes)
    assert sum(t.values()) == pytest.approx(1035) and all(t[s] <= 3 * n for s, n in sizes.items())
    assert t["a"] == 30 or t["a"] == pytest.approx(t["b"] / 2)


def test_flow_prefers_few_repeats():
    # x is in both sources, y only in b: x must serve a, so that nothing is repeated
    out = M.min_cost_mix({("a", "b"): 10, ("b",): 10}, {"a": 10, "b": 10})
    assert out == {("a", "b"): {"a": 10, "b": 0}, ("b",): {"b": 10}}
    out = M.min_cost_mix({("a",): 10, ("b",): 4}, {"a": 5, "b": 12})
    assert out == {("a",): {"a": 5}, ("b",): {"b": 12}}


def test_query_comes_near_targets(spark):
    rows = QUERIES["op1_mix_to_target_weights"](spark, SF).collect()
    again = QUERIES["op1_mix_to_target_weights"](spark, SF).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[r.source_size, r.target] += r.taken
        target[r.source_size, r.target] = r.target
        most[r.source_size, r.target] = max(most[r.source_size, r.target], r["size"])
        assert 0 <= r.taken <= 3 * r["size"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= most[s]


def test_odd_rows(spark, odd, empty):
    docs = odd.select("doc_id", F.array("source").alias("sources"), F.when(F.col("text").isNotNull(), F.char_length("text")).alias("size"))
    chosen, sizes, targets = M.mix(docs, contract_targets)
    assert chosen.count() == odd.count() and chosen.where("size = 0 and repeats > 0").count() == 0
    none, sizes, _ = M.mix(docs.where("false"), contract_targets)
    assert none.count() == 0 and sizes == {}
    out = M.mix_documents(odd, contract_targets, F.char_length("text"), F.array("source"))
    assert out.columns == odd.columns and out.where("text is null").count() == 0
    assert M.mix_documents(empty, contract_targets, F.char_length("text"), F.array("source")).count() == 0


def test_overlapping_sources(spark):
    rows = [(i, 10, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", None]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    chosen, sizes, _ = M.mix(docs, lambda s: {k: 300.0 for k in s})
    got = chosen.groupBy("sources").agg(F.sum(F.col("size") * F.col("repeats")).alias("n")).collect()
    assert sizes == {"a": 600, "b": 600, None: 300} and sum(r.n for r in got) == 900


def test_small_patterns_are_folded_when_there_are_many(spark):
    rows = [(i, 10, ["a", f"s{i % 7}"] if i % 2 else ["a", "b"]) for i in range(140)] + [(200, 5, []), (201, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    chosen, sizes, targets = M.mix(docs, lambda s: {k: 100.0 for k in s}, max_patterns=1)
    patterns = {tuple(r.sources) for r in chosen.select("sources").distinct().collect()}
    assert chosen.count() == 142 and sum(len(p) > 1 for p in patterns) == 1 and ("a", "b") in patterns
    taken = chosen.agg(F.sum(F.col("size") * F.col("repeats"))).first()[0]
    assert abs(taken - sum(targets.values())) <= 10 * len(sizes)

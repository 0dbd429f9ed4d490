"""The blocked search against brute force, and how little it ranks."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import blocked, search
from strandline.plans.queries import points
from strandline.plans.registry import ORACLES, QUERIES
from tests.conftest import oracle, rows


def given(spark, sf):
    return points(spark, f"/root/testdata/{sf}").select(F.lit(0).alias("place"), F.col("point_id").alias("id"), F.col("vector").alias("v"))


def test_equal_to_brute_force_and_few_are_ranked(spark):
    got = rows(QUERIES["vector_block_topk"](spark, "/root/testdata/sf0.1"))
    assert got == oracle("", ORACLES["vector_block_topk"], "/root/testdata/sf0.1")
    p = given(spark, "sf0.1")
    ranked = blocked.candidates(blocked.encode(p), p.where("id % 100 = 0"), 5).count()
    n, asked = p.count(), p.where("id % 100 = 0").count()
    print(f"ranked {ranked / asked:.1f} of {n} vectors a question")
    assert 5 * asked <= ranked <= n * asked / 3 / 10


def test_faster_than_the_fold(spark):
    p = given(spark, "sf0.1").unionByName(given(spark, "sf0.1").withColumn("id", F.col("id") + 10**6)).persist()
    asked = p.where("id % 20 = 0").persist()
    p.count(), asked.count()
    blocked.top_k(p, asked, 5).count()  # compiles
    took = {}
    start = time.perf_counter()
    one = blocked.top_k(p, asked, 5).select("question_id", "point_id").collect()
    took["blocks"], start = time.perf_counter() - start, time.perf_counter()
    fold = search.top_k_each(p.withColumnRenamed("id", "point_id").withColumnRenamed("v", "vector"), asked.select("place", F.col("id").alias("question_id"), F.col("v").alias("question")), 5, "place", "point_id", "vector")
    two = fold.select("question_id", "point_id").collect()
    took["fold"] = time.perf_counter() - start
    print(took)
    assert sorted(one) == sorted(two) and took["blocks"] < took["fold"]


@pytest.mark.parametrize("size", [3, 4096])
def test_places_ties_and_odd_vectors(spark, monkeypatch, size):
    monkeypatch.setattr(blocked, "VECTORS", size)
    monkeypatch.setattr(blocked, "QUESTIONS", size)
    monkeypatch.setattr(blocked, "TILE", 2)
    rng = np.random.default_rng(3)
    data = [(i % 2, i, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(0, 100 + i, [1.0, 0.0, 0.5, 0.25]) for i in range(25)]
    data += [(0, 200, None), (0, 201, [0.0] * 4), (1, 202, [1.0, None, 0.0, 0.0]), (0, 203, [float("nan")] * 4), (0, 206, [1.0]), (1, 207, []), (0, 208, [-2.0]), (5, 209, [1.0, 1.0])]
    df = spark.createDataFrame(data, "place int, id long, v array<double>")
    finite = {i: (p, np.array(v)) for p, i, v in data if v and None not in v and np.isfinite(v).all() and any(v)}
    got = {(r.question_id, r.rank): (r.point_id, r.score) for r in blocked.top_k(df, df, 5).collect()}
    assert set(got) == {(q, n + 1) for q, (p, a) in finite.items() for n in range(min(5, sum(p == p2 and len(a) == len(b) for p2, b in finite.values())))}
    assert [got[100, n][0] for n in range(1, 6)] == [100, 101, 102, 103, 104] == [got[124, n][0] for n in range(1, 6)]
    for (q, n), (i, score) in got.items():
        a, b = finite[q][1], finite[i][1]
        assert abs(score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-9
        others = sorted((-float(a @ x / np.sqrt((a @ a) * (x @ x))) for p, x in finite.values() if p == finite[q][0] and len(x) == len(a)))
        assert abs(-others[n - 1] - score) < 1e-9


def test_empty(spark):
    none = spark.createDataFrame([], "place int, id long, v array<double>")
    assert blocked.top_k(none, none).count() == 0


def test_collections_are_searched_by_blocks(spark):
    """Not by a cosine of every question with every point of its collection."""
    sf = "/root/testdata/sf0.01"
    df = QUERIES["vector_topk_per_collection"](spark, sf)
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    assert rows(df) == oracle("", ORACLES["vector_topk_per_collection"], sf)

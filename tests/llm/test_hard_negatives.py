import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import hard_negatives as H
from strandline.llm import queries
from tests.conftest import oracle, rows


def plainly(data, which, positives=5, negatives=3, low=50, high=95):
    data = [r for r in data if r[1] is not None and r[2] is not None and None not in r[2]]
    out = []

    def order(r):
        return -r[0], r[1] is None, r[1] or 0

    for i, label, v in data:
        if i is None or not which(i):
            continue
        others = [(sum(a * b for a, b in zip(v, x, strict=True)), j, la == label) for j, la, x in data if j != i and len(x) == len(v)]
        for p, pid, _ in sorted((o for o in others if o[2]), key=order)[:positives]:
            window = sorted((o for o in others if not o[2] and low * p <= 100 * o[0] <= high * p), key=order)[:negatives]
            out += [(i, pid, n + 1, nid, p, s) for n, (s, nid, _) in enumerate(window)]
    return sorted(out, key=repr)


def mined(spark, data, which, **more):
    df = spark.createDataFrame([(i, label, v, 1, b"") for i, label, v in data], "id long, label long, v array<long>, akey int, members binary")
    return sorted(map(tuple, H.mine(df, which, **more).collect()), key=repr)


@pytest.mark.parametrize("list_rows", [None, 3, 20])
def test_against_all_pairs(spark, list_rows):
    rng = np.random.default_rng(5)
    hubs = rng.normal(0, 40, (7, 6))
    data = [(i, int(rng.integers(3)), [int(x) for x in hubs[i % 7] + rng.normal(0, 9, 6)]) for i in range(260)]
    got = mined(spark, data, F.col("id") % 9 == 0, list_rows=list_rows)
    assert got == plainly(data, lambda i: i % 9 == 0) and len(got) > 100


def test_odd_rows(spark):
    same = [4, -3, 2]
    data = [(i, 0, same) for i in range(700)] + [(1000 + i, 1, [3, -3, 1]) for i in range(300)]  # equal vectors, more than a block holds
    data += [(5, 0, same), (5, 0, same), (None, 0, same), (None, 1, [3, -2, 1])]  # repeated rows, no id
    data += [(2000, None, same), (2001, 0, None), (2002, 1, [1, None, 2]), (2003, 0, []), (2004, 1, []), (2005, 0, [])]
    data += [(2010, 0, [1, 1]), (2011, 0, [2, 2]), (2012, 1, [1, 1]), (2013, 0, [0, 0, 0]), (2014, 2, [-9, 9, -9])]
    which = (F.col("id") % 350 == 0) | F.col("id").isin(5, 2003, 2010, 2013, 2014) | F.col("id").isNull()
    got = mined(spark, data, which)
    assert got == plainly(data, lambda i: i % 350 == 0 or i in (5, 2003, 2010, 2013, 2014))
    assert {r[0] for r in got} >= {5, 2003, 2010}


def test_scores_are_held_to_64_bits(spark):
    data = [(0, 0, [2**62, 2**62]), (1, 0, [2**62, 2**62]), (2, 1, [2, 1]), (3, 1, [1, 0])]
    most = 2**63 - 1
    assert mined(spark, data, F.col("id") < 1) == [(0, 1, 1, 3, most, 2**62)]  # 3 * 2^62 is held to the end, which is over the window


def test_exact_beyond_doubles(spark):
    data = [(0, 0, [2**30, 1]), (1, 0, [2**31, 5]), (2, 1, [2**30 + 1, 3]), (3, 1, [2**30 + 1, 2])]
    assert mined(spark, data, F.col("id") == 0) == plainly(data, lambda i: i == 0)


def test_empty_table(spark):
    assert mined(spark, [], F.col("id") == 0) == []


def test_bounds_skip_and_stop(spark):
    """Far lists are never asked: the visits of well separated hubs are a small part of anchors x lists."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (40, 16))
    centres = 1000 * centres / np.linalg.norm(centres, axis=1, keepdims=True)
    data = [(i, (i // 40) % 2, [int(x) for x in centres[i % 40] + rng.normal(0, 2, 16)]) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, label long, v array<long>")
    index = H.Index(df, list_rows=50)
    anchors = index.anchors(F.col("id") % 50 == 0).withColumn("searches", F.array(F.struct(F.lit(0).alias("s"), F.lit(-(2**63)).alias("low"), F.lit(2**63 - 1).alias("high"), F.lit(10**5).cast("long").alias("kth"))))
    visits = H._requests(anchors, index.lists, 0, len(index.lists.radii)).count()
    assert 40 <= visits <= 0.5 * 40 * len(index.lists.radii)
    with_window = anchors.withColumn("searches", F.transform("searches", lambda s: s.withField("high", F.lit(-(10**7)))))
    assert H._requests(with_window, index.lists, 0, len(index.lists.radii)).count() == 0


def test_query(spark):
    got = rows(queries.op11_hard_negatives(spark, "/root/testdata/sf0.01"))
    assert got == oracle("op11", queries.OP11_SQL, "/root/testdata/sf0.01") and got[1]


def test_components_that_are_no_numbers(spark, tmp_path):
    data = [(0, 1, [0.5, 0.25]), (1, 1, [0.5, math.nan]), (2, 1, [math.inf, 0.0]), (3, 1, [0.5, 0.5]), (4, None, [0.5, 0.5]), (6, 2, [0.25, 0.25]), (None, 2, [0.2, 0.25]), (8, 1, [0.2, 0.2])]
    spark.createDataFrame(data, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in queries.op11_hard_negatives(spark, str(tmp_path)).collect()]
    # vec_id 0 has label 2 after the shift: 6 and the row without an id are its positives, the score of 3 is above both windows
    assert sorted(got, key=repr) == [(0, 6, 1, 8, 12288, 9792), (0, None, 1, 8, 10624, 9792)]

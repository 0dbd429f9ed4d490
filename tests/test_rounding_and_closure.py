import math
import random

from pyspark.sql import functions as F

from strandline.functions.vectors import round_half_even
from strandline.operators.upsert import cascade_closure


def test_rounds_as_python_does(spark):
    rng = random.Random(4)
    values = [rng.uniform(-2, 2) for _ in range(20000)] + [k / 32 for k in range(-4000, 4000)] + [(2 * k + 1) / 20000 for k in range(-9000, 9000)]
    values += [math.nextafter((2 * k + 1) / 20000, s) for k in range(2000) for s in (-9, 9)] + [0.0, -0.0, 1e-300, 5e-324, 123456789.00005, 4e11, -4e11 - 0.00005]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", round_half_even(F.col("v")).alias("r")).collect()
    assert [(r.i, values[r.i]) for r in got if r.r != round(values[r.i], 4)] == []
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1e300,)], "v double").select(round_half_even(F.col("v"))).collect()
    assert odd[0][0] is None and math.isnan(odd[1][0]) and odd[2][0] == math.inf and odd[3][0] == 1e300


def test_closure_over_several_parents(spark):
    rows = lambda ddl, *data: spark.createDataFrame(data, ddl)
    tables = {
        "user": rows("id int", (1,), (2,)),
        "repo": rows("id int, owner int", (10, 1), (11, 2), (12, None)),
        "link": rows("id int, user_id int, repo_id int", (100, 1, 11), (101, 2, 10), (102, 2, 11), (103, None, 12)),
        "note": rows("id int, link_id int", (7, 100), (8, 101), (9, 102), (5, None)),
    }
    links = [("repo", "owner", "user", "id"), ("link", "user_id", "user", "id"), ("link", "repo_id", "repo", "id"), ("note", "link_id", "link", "id")]
    left = cascade_closure(tables, links, {"user": tables["user"].where("id = 1")})
    assert {n: sorted(r.id for r in df.collect()) for n, df in left.items()} == {"user": [2], "repo": [11, 12], "link": [102, 103], "note": [5, 9]}
    assert {n: df.count() for n, df in cascade_closure(tables, links, {}).items()} == {"user": 2, "repo": 3, "link": 4, "note": 4}

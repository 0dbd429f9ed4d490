"""What Python workers hold of large batches, and how often and how fast they do their work."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from strandline.functions import batches
from strandline.operators import chunking, embedding, search


def test_only_slices_of_a_batch_are_python_objects(spark):
    whole = lambda texts: pa.array([sum(len(t or "") for t in texts)] * len(texts), pa.int64())
    df = spark.range(3000, numPartitions=1).select("id", F.when(F.col("id") % 10 > 0, F.repeat(F.lit("x"), F.lit(10_000))).alias("t"))
    got = df.select("id", batches.by_slices(whole, "long")("t").alias("n")).agg(F.count("id").alias("rows"), F.max("n").alias("n")).first()
    assert got.rows == 3000 and got.n <= batches.SLICE_BYTES
    long = spark.createDataFrame([("y" * (3 << 20),), (None,), ("",)], "t string")
    assert sorted(r.n for r in long.coalesce(1).select(batches.by_slices(whole, "long")("t").alias("n")).collect())[-1] == 3 << 20
    assert spark.range(0).select(batches.by_slices(whole, "long")(F.col("id").cast("string"))).count() == 0


def test_headers_leave_chunks_in_the_task(spark):
    files = spark.createDataFrame([("r", "a.py", "py", "def f():\n    pass\n")], "repo_id string, path string, language string, content string")
    heads = chunking.file_headers(files)
    assert heads.first().chunks_indexed == 1
    assert "chunks#" not in heads._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_made_once_for_a_question(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, None), (4, "")], "point_id int, t string").withColumn("vector", embedding.embed(F.col("t")))
    best = search.top_k(df, embedding.embed_question("b c"), 4)
    assert best._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.point_id for r in best.collect()] == [2, 1]


def test_long_comments_take_time_in_proportion():
    start = time.perf_counter()
    chunks = chunking.chunk_file("a.js", "import a from 'b';\n" + "// x\n" * 60_000 + "class C { static async run(x) { return 1; } }\n", "js")[1]
    assert {c["name"] for c in chunks} >= {"C", "run"}
    assert time.perf_counter() - start < 5

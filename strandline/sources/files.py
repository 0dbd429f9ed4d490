"""[SRC-*] Files as rows; see ``repositories`` for the source that lists and reads them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(files: DataFrame) -> DataFrame:
    """[SRC-2] Files as text; those that are no UTF-8 are left out."""
    return files.withColumn("content", F.try_validate_utf8(F.col("content").cast("string"))).where("content is not null")


def repo_size_kb(files: DataFrame, default: int = 2000, by: Sequence[str] = ()) -> DataFrame:
    """[SRC-5] One row with the size in KB, or one for each group; ``default`` without files."""
    return files.groupBy(*by).agg(F.coalesce((F.sum("length") / 1024).cast("long"), F.lit(default)).alias("size_kb"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

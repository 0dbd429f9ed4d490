"""Vector search: exact cosine top-k over a collection, a file, or many questions at once; ``blocked`` is for very many.

Points are partitioned by collection and read with the filter and the columns pushed down; one question needs no shuffle
beyond its k best rows. Ties are broken by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.vectors import cosine, round_half_even

HIT = ("code", "file", "language", "type", "name", "start_line", "end_line")


def top_k(points: DataFrame, question: list[float], k: int = 5, id_col: str = "point_id", vector: str = "vector") -> DataFrame:
    """[TOP-1] The k rows nearest to ``question``, best first, with ``score``."""
    asked = F.lit([float(x) for x in question])
    scored = points.withColumn("score", cosine(F.col(vector), asked))
    # nulls come last; dropped before, they would have every vector that Python makes made twice
    return scored.orderBy(F.desc("score"), id_col).limit(k).where("score is not null")


def hits(found: DataFrame) -> DataFrame:
    """[PRJ-1]"""
    return found.select(*HIT, "score")


def file_top_k(points: DataFrame, question: list[float], file: str, k: int = 5, id_col: str = "point_id", vector: str = "vector") -> DataFrame:
    """[TOP-2, FLT-8, PRJ-2] The same inside one file: the filter comes before any score."""
    found = top_k(points.where(F.col("file") == file), question, k, id_col, vector)
    return found.select("code", "start_line", "end_line", round_half_even(F.col("score")).alias("score"))


def top_k_each(points: DataFrame, questions: DataFrame, k: int, on: str, id_col: str, vector: str) -> DataFrame:
    """[JOIN-5] For each row of ``questions`` (question_id, ``on``, question) its k nearest points of the same collection.

    Questions meet points by their collection; each task keeps k rows of a question before they are shuffled by it.
    """
    near = points.join(questions, on).withColumn("score", cosine(F.col(vector), F.col("question"))).where("score is not null")
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), id_col))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)

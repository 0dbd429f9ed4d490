"""[TOP-1, JOIN-5] Exact cosine top-k of many questions by blocked matrix products over vectors stored as int8.

A block holds some thousand unit vectors as int8 codes, each with its scale and with the length of what the codes leave out. That length
bounds how far a product with the codes is from the cosine, so a block knows of each vector the least and the greatest score that it
can have: only vectors whose greatest score reaches the k-th best least score are ranked by their exact cosine. No neighbour is lost
to the codes. Blocks of questions meet blocks of vectors in tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.vectors import cosine

#: Vectors and questions of a block, and blocks at a side of a tile.
VECTORS, QUESTIONS, TILE = 4096, 256, 16
_PLACE = ("place", "dim")


def _units(vectors: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows, and which rows have one: nulls, zero vectors and such with null or non-finite components have none."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(len(vectors), dim)
    top = np.abs(x).max(axis=1, initial=0)
    sound = np.isfinite(top) & (top > 0)
    x = x / np.where(sound, top, 1)[:, None]
    return np.nan_to_num(x / np.where(sound, np.sqrt((x * x).sum(axis=1)), 1)[:, None]), sound


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (rows of id and vector, by id) as codes, with the place of each among the block's equal vectors."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows, dim = batch.column("rows")[i].values, batch.column("dim")[i].as_py()
            unit, sound = _units(pc.struct_field(rows, "v"), dim)
            at = np.flatnonzero(sound)
            scale = np.abs(unit[at]).max(axis=1, initial=0) / 127
            codes = np.rint(unit[at] / scale[:, None]).astype(np.int8)
            # and what products of single precision may be off
            lost = np.sqrt(((unit[at] - codes * scale[:, None]) ** 2).sum(axis=1)) + 1e-6 + dim * 1.2e-7
            plain, seen = pc.struct_field(rows, "v").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dim), {}
            nth = np.empty(len(at), dtype=np.int32)
            for j, vector in enumerate(v.tobytes() for v in plain[at]):
                nth[j] = seen[vector] = seen.get(vector, -1) + 1
            out = {n: batch.column(n).slice(i, 1) for n in ("place", "dim", "block")}
            ids = pc.struct_field(rows, "id").take(pa.array(at))
            listed = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids)
            yield pa.RecordBatch.from_pydict(out | {"ids": listed, "codes": pa.array([codes.tobytes()], pa.binary()), "scale": pa.array([scale.tobytes()], pa.binary()), "lost": pa.array([lost.tobytes()], pa.binary()), "nth": pa.array([nth.tobytes()], pa.binary())})


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(place, dim, block, blocks, rows): the rows (place, id, v) of each place and length of vector in blocks of about ``size``, by id."""
    sized = rows.withColumn("dim", F.size("v"))
    counts = sized.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / size).cast("int")).drop("n")
    block = F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int")
    return sized.join(counts, list(_PLACE)).groupBy(*_PLACE, "blocks", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows"))


def encode(points: DataFrame) -> DataFrame:
    """(place, dim, block, ids, codes, scale, lost, nth) for points (place, id, v): what a search reads. May be stored and used again."""
    id_type = points.schema["id"].dataType.simpleString()
    place = points.schema["place"].dataType.simpleString()
    finite = points.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & (F.size("v") > 0))
    blocks = _blocks(finite, VECTORS).select(*_PLACE, "block", "rows")
    return blocks.mapInArrow(_encode, f"place {place}, dim int, block int, ids array<{id_type}>, codes binary, scale binary, lost binary, nth binary")


def _bounded(k: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For pairs of a block of questions and a block of codes: the points that may be among a question's k best of the block."""
        for batch in batches:
            for i in range(batch.num_rows):
                asked, dim, ids = batch.column("rows")[i].values, batch.column("dim")[i].as_py(), batch.column("ids")[i].values
                questions, sound = _units(pc.struct_field(asked, "v"), dim)
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.int8).reshape(len(ids), dim)
                scale, lost = (np.frombuffer(batch.column(c)[i].as_py(), np.float64) for c in ("scale", "lost"))
                # of equal vectors only the k with the smallest ids can be hits
                kept = np.flatnonzero(np.frombuffer(batch.column("nth")[i].as_py(), np.int32) < k)
                codes, scale, lost = codes[kept], scale[kept], lost[kept]
                near = (codes.astype(np.float32) @ questions.astype(np.float32).T).T * scale
                least = near - lost
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for j in np.flatnonzero(sound):
                    floor = np.partition(least[j], -k)[-k] if len(kept) > k else -np.inf
                    at = np.flatnonzero(near[j] + lost >= floor)
                    out.append((np.full(len(at), j), at, least[j, at]))
                if out:
                    q, p, low = (np.concatenate(x) for x in zip(*out, strict=True))
                    keys = pc.struct_field(asked, "id").take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([keys, ids.take(pa.array(kept[p])), pa.array(low), pa.array(low + 2 * lost[p])], ["question_id", "point_id", "least", "most"])

    return meet


def candidates(encoded: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(question_id, point_id): the points of a question's place that its k best are among; ``questions`` are (place, id, v)."""
    finite = questions.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & (F.size("v") > 0))
    asked = _blocks(finite, QUESTIONS)
    tile = lambda c: (F.col(c) / TILE).cast("int")
    tiles = lambda c: F.explode(F.sequence(F.lit(0), F.col(c)))
    own = encoded.groupBy(*_PLACE).agg(F.max(tile("block")).alias("p_tiles")).join(asked.groupBy(*_PLACE).agg(F.max(tile("block")).alias("q_tiles")), list(_PLACE))
    left = encoded.join(own, list(_PLACE)).withColumn("p", tile("block")).withColumn("q", tiles("q_tiles")).select(*_PLACE, "p", "q", "ids", "codes", "scale", "lost", "nth")
    right = asked.join(own, list(_PLACE)).withColumn("q", tile("block")).withColumn("p", tiles("p_tiles")).select(*_PLACE, "p", "q", "rows")
    q_type, p_type = questions.schema["id"].dataType.simpleString(), encoded.schema["ids"].dataType.elementType.simpleString()
    met = left.join(right, [*_PLACE, "p", "q"]).mapInArrow(_bounded(k), f"question_id {q_type}, point_id {p_type}, least double, most double")
    nth = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("least")))
    floor = met.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("question_id").agg(F.min("least").alias("floor"), F.count(F.lit(1)).alias("n"))
    return met.join(floor, "question_id").where((F.col("n") < k) | (F.col("most") >= F.col("floor"))).select("question_id", "point_id")


def top_k(points: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(question_id, point_id, score, rank): for each of ``questions`` (place, id, v) the k points (place, id, v) of its place with the
    greatest cosine, ties by smaller id. Ids are unique. Vectors that are null, zero, of another length or hold null or non-finite components have
    no score."""
    found = candidates(encode(points), questions, k)
    exact = found.join(points.select(F.col("id").alias("point_id"), "v"), "point_id").join(questions.select(F.col("id").alias("question_id"), F.col("v").alias("asked")), "question_id")
    scored = exact.select("question_id", "point_id", cosine(F.col("v"), F.col("asked")).alias("score"))
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), "point_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)

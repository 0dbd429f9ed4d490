"""Hard negatives by exact search in k-means inverted lists.

Every row is indexed in the list of its nearest centroid; a list keeps its radius, the distance of its farthest row. For an anchor q no
row of a list with centroid c and radius r scores above q.c + |q| r or below q.c - |q| r (Cauchy-Schwarz). An anchor visits lists by
falling upper bound, in rounds of growing size; it skips lists that its window of scores doesn't meet, and a search is over when
the bound falls strictly below its k-th best score. The bounds only save work: the result is that of a scan of all rows.

Lists are stored in blocks of a bounded size, so a list with a third of all rows is many rows here; blocks of anchors meet blocks of
lists in tiles of bounded size. The driver holds centroids, radii and counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import materialize, release

#: Rows and bytes of the sample that centroids are fitted to; every row is indexed.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 64 << 20
#: At most so many lists, and so many bytes of centroids, which all tasks hold.
MAX_LISTS, CENTROID_BYTES, STEPS = 1024, 8 << 20, 8
#: Bytes of vectors in a block of a list, anchors in a block, blocks at a side of a tile.
BLOCK_BYTES, ANCHORS, TILE = 256 << 10, 256, 16
LEAST, MOST = -(2**63), 2**63 - 1

_ASKED = "akey long, id long, label long, v array<long>, searches array<struct<s: int, low: long, high: long, kth: long>>"


def _matrices(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the vectors of each length."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(d))


def _fit(sample: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's steps from k rows of the sample."""
    centres = sample[np.random.default_rng(11).choice(len(sample), k, replace=False)].copy()
    for _ in range(STEPS):
        near = _nearest(sample, centres)
        sizes = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms, out = (centres**2).sum(1), np.empty(len(rows), dtype=np.int64)
    for i in range(0, len(rows), 1024):
        out[i : i + 1024] = np.argmin(norms - 2 * (rows[i : i + 1024] @ centres.T), axis=1)
    return out


class Lists:
    """Centroids and radii. List i < k is that of centre i, list k + d that of the vectors with d components where the centres have another
    number; its centre is 0."""

    def __init__(self, centres: np.ndarray):
        self.centres, self.k, self.radii = centres, len(centres), {}

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each row and its distance from the centre."""
        rows = rows.astype(float)
        if self.k and rows.shape[1] == self.centres.shape[1]:
            near = _nearest(rows, self.centres)
            return near, np.sqrt(((rows - self.centres[near]) ** 2).sum(1))
        return np.full(len(rows), self.k + rows.shape[1]), np.sqrt((rows**2).sum(1))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists in the order of their visit, with the least and the greatest score that a row of each can have."""
        q = q.astype(float)
        if self.k and len(q) == self.centres.shape[1]:
            lists = np.array([i for i in range(self.k) if i in self.radii], dtype=np.int64)
            centres = self.centres[lists]
        else:
            lists = np.array([i for i in (self.k + len(q),) if i in self.radii], dtype=np.int64)
            centres = np.zeros((len(lists), len(q)))
        middle, norm = centres @ q, np.sqrt(q @ q)
        radius = np.array([self.radii[i] for i in lists])
        slack = 1e-9 * norm * (np.sqrt((centres**2).sum(1)) + radius) + 1e-6
        upper, lower = middle + norm * radius + slack, middle - norm * radius - slack
        order = np.argsort(-upper, kind="stable")
        # scores beyond 64 bits are held to their ends, and so lie inside bounds that are
        return lists[order], np.minimum(lower, np.nextafter(float(MOST), 0))[order], np.maximum(upper, float(LEAST))[order]


def _scores(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles as long as no sum can reach 2^53, else in Python's integers, held to 64 bits."""
    most = float(np.abs(asked.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0)) * asked.shape[1]
    if most < 2**53:
        return (asked.astype(float) @ rows.astype(float).T).astype(np.int64)
    exact = asked.astype(object) @ rows.astype(object).T
    return np.vectorize(lambda x: min(max(int(x), LEAST), MOST), otypes=[np.int64])(exact)


def _best(scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: higher scores first, ties by smaller id, rows without one last."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.lexsort((ids[at], no_id[at], -scores[at]))[:k]]


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _requests(anchors: DataFrame, lists: Lists, start: int, stop: int) -> DataFrame:
    """(cluster, asked): each anchor with its open searches, for each list that it visits at positions ``start`` to ``stop``."""
    schema = pa.schema([("cluster", pa.int64()), ("row", pa.int32()), ("open", pa.list_(pa.int32()))])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            searches, out = batch.column("searches").to_pylist(), ([], [], [])
            for at, rows in _matrices(batch.column("v")):
                for i, q in zip(at, rows, strict=True):
                    order, lower, upper = (x[start:stop] for x in lists.bounds(q))
                    for c, lo, hi in zip(order, lower, upper, strict=True):
                        left = [n for n, s in enumerate(searches[i]) if hi >= s["kth"] and hi >= s["low"] and lo <= s["high"]]
                        if left:
                            for column, value in zip(out, (c, i, left), strict=True):
                                column.append(value)
            met = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
            for i in range(0, met.num_rows, 1024):
                part = met.slice(i, 1024)
                own = batch.take(part.column("row"))
                kept = [[searches[r][n] for n in left] for r, left in zip(part.column("row").to_pylist(), part.column("open").to_pylist(), strict=True)]
                columns = {n: own.column(n) for n in ("akey", "id", "label", "v")} | {"searches": pa.array(kept, batch.schema.field("searches").type)}
                yield pa.RecordBatch.from_pydict({"cluster": part.column("cluster")} | columns)

    return anchors.mapInArrow(visits, f"cluster long, {_ASKED}")


def _answers(same: bool, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (asked, members): each search's k best members of the block, of the anchor's label or of others."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, members = batch.column("asked")[i].values, batch.column("members")[i].values
                field = pc.struct_field
                (_, questions), (_, rows) = next(_matrices(field(asked, "v"))), next(_matrices(field(members, "v")))
                scores, (ids, no_id) = _scores(questions, rows), _ids(field(members, "id"))
                labels, keys = field(members, "label").to_numpy(zero_copy_only=False), field(asked, "akey").to_numpy(zero_copy_only=False)
                own_ids, own_labels = field(asked, "id").to_numpy(zero_copy_only=False), field(asked, "label").to_numpy(zero_copy_only=False)
                out: list[tuple] = []
                for j, searches in enumerate(field(asked, "searches").to_pylist()):
                    fits = np.flatnonzero(((labels == own_labels[j]) == same) & (no_id | (ids != own_ids[j])))
                    for s in searches:
                        score = scores[j, fits]
                        at = fits[(score >= max(s["low"], s["kth"])) & (score <= s["high"])]
                        best = at[_best(scores[j, at], ids[at], no_id[at], k)]
                        out += [(keys[j], s["s"], None if no_id[b] else ids[b], scores[j, b]) for b in best]
                columns = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["akey", "s", "id", "score"])

    return answer


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("akey", "s").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


class Index:
    """Inverted lists over ``rows`` (id long, label long, v array<long>), in blocks in the shared folder."""

    def __init__(self, rows: DataFrame, list_rows: int | None = None):
        self.spark = rows.sparkSession
        stored = materialize(rows.select("id", "label", "v"))
        sizes = {r["d"]: r["count"] for r in stored.groupBy(F.size("v").alias("d")).count().collect()}
        d = max(sizes, key=lambda x: (sizes[x], x), default=0)
        n = sizes.get(d, 0)
        most = max(1, min(MAX_LISTS, CENTROID_BYTES // (8 * max(1, d))))
        k = min(most, n, -(-n // list_rows) if list_rows else round(n**0.5 / 2) + 1) if d else 0
        limit = max(k, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, d))))
        some = stored.where((F.size("v") == d) & (F.rand(11) < min(1.0, 1.2 * limit / max(1, n)))).select("v").limit(limit).toArrow() if k else None
        sample = np.vstack([m for c in some.column("v").chunks for _, m in _matrices(c)] or [np.empty((0, d))]).astype(float) if k else np.empty((0, d))
        self.lists = Lists(_fit(sample, min(k, len(sample))))
        assigned = materialize(self._assigned(stored))
        # as many rows as there are lists and lengths of vectors
        stats = assigned.groupBy("cluster", F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
        self.lists.radii = {r["cluster"]: r["far"] for r in stats}
        blocks = [(r["cluster"], -(-r["n"] // max(64, BLOCK_BYTES // (8 * max(1, r["d"]))))) for r in stats]
        self.blocks = self.spark.createDataFrame(blocks, "cluster long, blocks int")
        block = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("blocks")).cast("int")
        members = assigned.join(F.broadcast(self.blocks), "cluster").withColumn("block", block)
        self.members = materialize(members.groupBy("cluster", "block").agg(F.collect_list(F.struct("id", "label", "v")).alias("members")))
        release(stored)
        self._assigned_rows = assigned

    def _assigned(self, rows: DataFrame) -> DataFrame:
        lists = self.lists

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cluster, far = np.empty(batch.num_rows, dtype=np.int64), np.empty(batch.num_rows)
                for at, matrix in _matrices(batch.column("v")):
                    cluster[at], far[at] = lists.of(matrix)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(far)], ["id", "label", "v", "cluster", "far"])

        return rows.mapInArrow(assign, "id long, label long, v array<long>, cluster long, far double")

    def anchors(self, which: Column) -> DataFrame:
        rows = self._assigned_rows.where(which & F.col("id").isNotNull())
        return materialize(rows.select(F.monotonically_increasing_id().alias("akey"), "id", "label", "v"))

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(akey, s, id, score, rank): for each search of ``anchors`` (akey, id, label, v, searches of (s, low, high)) its k best
        rows, other than the anchor's id, of the anchor's label or of others, with scores from ``low`` to ``high``."""
        parts = -(-anchors.count() // ANCHORS)
        tiles = -(-parts // TILE)
        best = self.spark.createDataFrame([], "akey long, s int, id long, score long, rank int")
        start, stop, total = 0, 2, len(self.lists.radii)
        while start < total and parts:
            kth = best.groupBy("akey", "s").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
            known = kth.groupBy("akey").agg(F.map_from_entries(F.collect_list(F.struct("s", "kth"))).alias("known"))
            level = lambda x: F.coalesce(F.try_element_at("known", x["s"]), F.lit(LEAST))
            opened = F.transform("searches", lambda x: F.struct(x["s"].alias("s"), x["low"].alias("low"), x["high"].alias("high"), level(x).alias("kth")))
            open_ = anchors.join(known, "akey", "left").select("akey", "id", "label", "v", opened.alias("searches"))
            part = F.pmod(F.xxhash64("akey"), F.lit(parts)).cast("int")
            asked = _requests(open_, self.lists, start, stop).groupBy("cluster", part.alias("part")).agg(F.collect_list(F.struct(*(c.split()[0] for c in _ASKED.split(", ")[:4]), "searches")).alias("asked"))
            each = F.explode(F.sequence(F.lit(0), ((F.col("blocks") - 1) / TILE).cast("int")))
            left = asked.join(F.broadcast(self.blocks), "cluster").withColumn("of", (F.col("part") / TILE).cast("int")).withColumn("tile", each).drop("blocks")
            right = self.members.withColumn("tile", (F.col("block") / TILE).cast("int")).withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
            pairs = left.join(right, ["cluster", "tile", "of"]).select("asked", "members")
            found = pairs.mapInArrow(_answers(same, k), "akey long, s int, id long, score long")
            after = materialize(_top(best.drop("rank").unionByName(found), k))
            if start:
                release(best)
            best, start, stop = after, stop, 4 * stop
        return best

    def release(self) -> None:
        """Deletes the index; results that were given stay."""
        release(self._assigned_rows, self.members)


def mine(rows: DataFrame, which: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, list_rows: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``which`` names, by id, as anchors.

    ``rows``: (id long, label long, v array<long>), all three columns as they shall count; a row's score is its inner product with
    the anchor. An anchor's positives are its first ``positives`` other rows of the same label, and a positive's negatives its first
    ``negatives`` rows of other labels whose score is from ``low`` to ``high`` hundredths of the positive's (0 <= low <= high); higher
    scores come first, ties by smaller id, null ids last. Rows with a null label, vector or component take no part. "Other" rows
    have another id, or none; a row without an id is no anchor. Repeated rows are rows: they hold a rank each, and repeated anchors
    give repeated results. Vectors of different lengths have no score. Scores are exact within 64 bits and held to their ends
    beyond. No rows give no rows; other columns are not read.
    """
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    index = Index(rows.where(sound), list_rows)
    anchors = index.anchors(which)
    search = lambda s, lo, hi: F.struct(F.lit(s).cast("int").alias("s"), lo.cast("long").alias("low"), hi.cast("long").alias("high"))
    near = index.search(anchors.withColumn("searches", F.array(search(0, F.lit(LEAST), F.lit(MOST)))), True, positives)
    hundredths = lambda n, more: F.expr(f"({n} * cast(score as decimal(20, 0)) + {more}) div 100")
    windows = near.where("score >= 0").select("akey", F.struct(F.col("rank").alias("s"), hundredths(low, 99).alias("low"), hundredths(high, 0).alias("high")).alias("w"))
    asked = anchors.join(windows.groupBy("akey").agg(F.collect_list("w").alias("searches")), "akey")
    hard = index.search(materialized := materialize(asked), False, negatives)
    release(materialized)
    index.release()
    named = anchors.select("akey", F.col("id").alias("anchor_id")).join(near.select("akey", F.col("rank").alias("s"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "akey")
    found = hard.select("akey", "s", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(found, ["akey", "s"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

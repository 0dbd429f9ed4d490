"""Near-duplicate embeddings by navigable small-world graphs, one for each shard.

Every vector is put into the graph of its shard and queries every shard. A graph is built in doubling batches: a batch
searches the graph of all before it and compares itself by brute force, links keep both near and diverse neighbours,
and upper layers hold every 16th node of the layer below. A query descends greedily, searches layer 0 with a beam, and
then follows every link between vectors near the threshold, however many there are. Recall is audited against brute
force on a sample of each shard, and the beam is doubled until the audit passes; a beam as wide as the shard is exact.
Cosines of what was found are taken in double precision before a pair is a link.

Links are not listed: a query reports how many it has in a shard and which components of the shard they belong to, so
that a group of thousands of near copies costs no table of pairs. Components of shards are then joined over all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import broadcast_if_small, materialize
from strandline.llm.components import connected_components

THRESHOLD = 0.95
#: Vectors of a shard at most, their bytes (in double and single precision), and shards at least. More or longer vectors make more
#: shards, never larger ones.
SHARD_ROWS, SHARD_BYTES, SHARDS = 100_000, 200 << 20, 6
#: Queries that one task answers; more queries make more tasks, each of which builds the shard's graph.
QUERY_ROWS = 2_000_000
#: Links of a node in layer 0 and above, beam while building and at first while querying.
DEGREE0, DEGREE, BUILD_BEAM, BEAM = 32, 16, 64, 24
#: Entry points of a layer, and up to how many nodes a layer is compared whole to find them.
ENTRIES, SCANNED = 8, 4096
#: Nodes expanded at once for each query; vectors under the threshold by this much are still followed.
STEP, SLACK = 4, 0.1
#: Vectors of a shard's audit, and of that of a batch of other shards' vectors, each taken twice: at random, and among those
#: with links. The mean recall of vectors that is asked for at each number of links (by powers of two).
AUDIT, AUDIT_ASKED, RECALL = 256, 64, 0.99


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1. They are first scaled by powers of two, so that no square overflows or vanishes; that changes no digit of others."""
    x = np.asarray(x, dtype=np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; searches run for many queries at once."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.exact = unit(vectors)
        self.x = self.exact.astype(np.float32)
        n = len(self.x)
        random = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - random.random(n)) / math.log(16)).astype(int), 8)
        # nodes are put in by falling level, so that every layer is a prefix of the order
        self.order = np.argsort(-levels, kind="stable")
        self.exact, self.x = self.exact[self.order], self.x[self.order]
        self.sizes = [int((levels >= level).sum()) for level in range(int(levels.max(initial=0)) + 1)]
        self.links = [np.full((size, DEGREE if level else DEGREE0), -1, dtype=np.int32) for level, size in enumerate(self.sizes)]
        for level in reversed(range(len(self.sizes))):
            self._build(level)

    def _build(self, level: int) -> None:
        links, size = self.links[level], self.sizes[level]
        # until the nodes of the layer above are all in this one, they are no entry points to it: batches are compared whole
        whole = max(2048, self.sizes[level + 1] if level + 1 < len(self.sizes) else 0)
        done = 1
        while done < size:
            end = min(size, 2 * done, done + 1024)
            new = np.arange(done, end)
            among = self.x[new] @ self.x[new].T
            np.fill_diagonal(among, -2)
            near = np.argsort(-among, axis=1)[:, : 2 * links.shape[1]]
            ids, sims = new[near], np.take_along_axis(among, near, axis=1)
            if done <= whole:
                old = self.x[new] @ self.x[:done].T
                found = np.argsort(-old, axis=1)[:, :BUILD_BEAM]
                found_sims = np.take_along_axis(old, found, axis=1)
            else:
                entry = self._descend(self.x[new], level, ENTRIES)
                found, found_sims = self._beam(self.x[new], entry, BUILD_BEAM, level, done)
            ids, sims = np.concatenate((ids, found), axis=1), np.concatenate((sims, found_sims), axis=1)
            links[new] = self._choose(ids, sims, links.shape[1])
            self._link_back(links, new)
            done = end

    def _choose(self, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """For each row of candidates the nearest half of ``degree``, and then those nearer to the row's node than to
        anything chosen; where these are too few, the next nearest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * degree]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        usable = (ids >= 0) & (sims > -2)
        count, width = ids.shape
        out = np.full((count, degree), -1, dtype=np.int32)
        for s in range(0, count, 256):
            part, ok = ids[s : s + 256], usable[s : s + 256]
            v = self.x[np.maximum(part, 0)]
            between = np.einsum("bid,bjd->bij", v, v, optimize=True)
            rows = np.arange(len(part))
            taken = np.zeros_like(ok)
            closest = np.full(part.shape, -2.0, dtype=np.float32)  # to anything chosen so far
            for j in range(width):
                full = taken.sum(axis=1) >= degree
                pick = ok[:, j] & ~full & ((j < degree // 2) | (closest[:, j] < sims[s : s + 256, j]))
                taken[:, j] = pick
                closest = np.where(pick[:, None], np.maximum(closest, between[:, j, :]), closest)
            rank = np.where(taken, 0, np.where(ok, 1, 2)) * width + np.arange(width)
            best = np.argsort(rank, axis=1)[:, :degree]
            chosen = np.where(ok[rows[:, None], best], part[rows[:, None], best], -1)
            out[s : s + 256, : chosen.shape[1]] = chosen
        return out

    def _link_back(self, links: np.ndarray, new: np.ndarray) -> None:
        """Adds the reverse of each new link; a node with too many chooses again."""
        to = links[new].ravel()
        back = np.repeat(new, links.shape[1])[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, starts, counts = np.unique(to, return_index=True, return_counts=True)
        width = int(counts.max(initial=0))
        for s in range(0, len(nodes), 4096):
            at = nodes[s : s + 4096]
            extra = np.full((len(at), width), -1, dtype=np.int64)
            for i, (b, c) in enumerate(zip(starts[s : s + 4096], counts[s : s + 4096], strict=True)):
                extra[i, :c] = back[b : b + c]
            both = np.concatenate((links[at].astype(np.int64), extra), axis=1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            room = (both >= 0).sum(axis=1) <= links.shape[1]
            packed = -np.sort(-both[room], axis=1)[:, : links.shape[1]]
            links[at[room], : packed.shape[1]] = packed
            crowded = both[~room]
            if len(crowded):
                sims = np.where(crowded >= 0, np.einsum("bd,bjd->bj", self.x[at[~room]], self.x[np.maximum(crowded, 0)], optimize=True), -2)
                links[at[~room]] = self._choose(crowded, sims, links.shape[1])

    def _descend(self, q: np.ndarray, level: int, entries: int) -> np.ndarray:
        """The best ``entries`` entry points for ``level`` that the layers above give, -1 where there are fewer. The highest
        layer of at most ``SCANNED`` nodes is compared whole, those below it are searched by beams."""
        top = next(above for above in range(len(self.sizes)) if self.sizes[above] <= SCANNED or above == len(self.sizes) - 1)
        if top <= level:
            return np.zeros((len(q), 1), dtype=np.int64)
        sims = q @ self.x[: self.sizes[top]].T
        width = min(entries, sims.shape[1])
        entry = np.argpartition(-sims, width - 1, axis=1)[:, :width].astype(np.int64)
        for above in range(top - 1, level, -1):
            entry = self._beam(q, entry, entries, above, self.sizes[above])[0]
        return entry

    def _beam(self, q: np.ndarray, entry: np.ndarray, ef: int, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines): the ``ef`` best nodes found for each query, best first."""
        n, links = len(q), self.links[level]
        visited = np.zeros((n, size), dtype=bool)
        ids = np.full((n, ef), -1, dtype=np.int64)
        sims = np.full((n, ef), -2, dtype=np.float32)
        open_ = np.zeros((n, ef), dtype=bool)
        width = min(ef, entry.shape[1])
        ids[:, :width] = entry[:, :width]
        r, c = np.nonzero(ids >= 0)
        sims[r, c] = np.einsum("ad,ad->a", q[r], self.x[ids[r, c]])
        open_[r, c] = True
        visited[r, ids[r, c]] = True
        active = np.arange(n)
        step = min(STEP, ef)
        while len(active):
            # beams are sorted, so the first open places are the best
            places = np.argsort(~open_[active], axis=1, kind="stable")[:, :step]
            is_open = np.take_along_axis(open_[active], places, axis=1)
            nodes = np.where(is_open, np.take_along_axis(ids[active], places, axis=1), -1)
            np.put_along_axis(open_, places, False, axis=1) if len(active) == n else open_.__setitem__((active[:, None], places), False)
            near = links[np.maximum(nodes, 0)]
            near = np.where((nodes >= 0)[:, :, None], near, -1).reshape(len(active), -1).astype(np.int64)
            near[(near >= size) | visited[active[:, None], np.maximum(near, 0)]] = -1
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            r, c = np.nonzero(near >= 0)
            fresh = near[r, c]
            visited[active[r], fresh] = True
            found = np.full(near.shape, -2, dtype=np.float32)
            found[r, c] = np.einsum("ad,ad->a", q[active[r]], self.x[fresh])
            all_ids = np.concatenate((ids[active], near), axis=1)
            all_sims = np.concatenate((sims[active], found), axis=1)
            all_open = np.concatenate((open_[active], near >= 0), axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            ids[active] = np.take_along_axis(all_ids, best, axis=1)
            sims[active] = np.take_along_axis(all_sims, best, axis=1)
            open_[active] = np.take_along_axis(all_open, best, axis=1)
            active = active[open_[active].any(axis=1)]
        return ids, sims

    def links_of(self, exact: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of every pair found with a cosine of at least ``threshold`` in double precision."""
        size, found_q, found_n = len(self.x), [], []
        width = max(1, min(512, 20_000_000 // max(1, size)))
        for s in range(0, len(exact), width):
            part = exact[s : s + width]
            q = part.astype(np.float32)
            if beam >= size:
                r, c = np.nonzero(q @ self.x.T >= threshold - 1e-4)
            else:
                ids, sims = self._beam(q, self._descend(q, 0, ENTRIES), beam, 0, size)
                r, c = np.nonzero(sims >= threshold - SLACK)
                c = ids[r, c]
                hits_r, hits_c = [r], [c]
                seen = np.zeros((len(q), size), dtype=bool)  # nodes that left the beam are looked at again
                seen[r, c] = True
                while len(r):  # follow all links between vectors near the threshold
                    next_r, next_c = [], []
                    for t in range(0, len(r), 20_000):
                        near = self.links[0][c[t : t + 20_000]].astype(np.int64)
                        rr, nn = np.repeat(r[t : t + 20_000], near.shape[1]), near.ravel()
                        rr, nn = rr[nn >= 0], nn[nn >= 0]
                        fresh = ~seen[rr, nn]
                        pair = np.unique(rr[fresh] * size + nn[fresh])
                        rr, nn = pair // size, pair % size
                        seen[rr, nn] = True
                        good = np.einsum("ad,ad->a", q[rr], self.x[nn]) >= threshold - SLACK
                        next_r.append(rr[good])
                        next_c.append(nn[good])
                    r, c = np.concatenate(next_r), np.concatenate(next_c)
                    hits_r.append(r)
                    hits_c.append(c)
                r, c = np.concatenate(hits_r), np.concatenate(hits_c)
            for t in range(0, len(r), 200_000):
                rr, cc = r[t : t + 200_000], c[t : t + 200_000]
                good = np.einsum("ad,ad->a", part[rr], self.exact[cc]) >= threshold
                found_q.append(rr[good] + s)
                found_n.append(cc[good])
        empty = np.empty(0, dtype=np.int64)
        return np.concatenate(found_q or [empty]), np.concatenate(found_n or [empty])

    def audit(self, exact: np.ndarray, own: np.ndarray | None, threshold: float, beam: int, recall: float = RECALL) -> tuple[int, float]:
        """(beam, recall): the first beam, doubling, that finds enough of the links of these vectors; the recall is the mean
        over vectors at the number of links where it is least. ``own`` has their places where they are of this graph."""
        truth = np.zeros(len(exact), dtype=np.int64)
        for s in range(0, len(exact), 64):
            near = exact[s : s + 64] @ self.exact.T >= threshold
            if own is not None:
                near[np.arange(len(near)), own[s : s + 64]] = False
            truth[s : s + 64] = near.sum(axis=1)
        level = np.where(truth > 0, link_level(truth), -1)
        while True:
            q, n = self.links_of(exact, threshold, beam)
            got = np.bincount(q if own is None else q[own[q] != n], minlength=len(exact))
            least = min(((got[level == k] / truth[level == k]).mean() for k in np.unique(level[truth > 0])), default=1.0)
            if least >= recall or beam >= len(self.x):
                return beam, float(least)
            beam *= 2

    def audited_beam(self, threshold: float, beam: int = BEAM, recall: float = RECALL, rows: int = AUDIT) -> tuple[int, float]:
        """(beam, recall): ``audit`` of a sample of the graph's own vectors."""
        size = len(self.x)
        sample = np.random.default_rng(11).permutation(size)[:rows]
        # half of the sample from vectors that have links at all, as far as these are easily found
        probed = np.random.default_rng(13).permutation(size)[: 8 * rows]
        q, n = self.links_of(self.exact[probed], threshold, beam)
        q, n = q[probed[q] != n], n[probed[q] != n]
        linked, first = np.unique(n, return_index=True)
        links = np.bincount(q, minlength=len(probed))[q[first]]
        sample = np.unique(np.concatenate((sample, linked[spread(links, rows, 17)])))
        return self.audit(self.exact[sample], sample, threshold, beam, recall)


def link_level(links: np.ndarray) -> np.ndarray:
    """The power of two below each number of links."""
    return np.log2(np.maximum(links, 1)).astype(int)


def spread(links: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """Places of at most ``rows`` of these numbers of links, as evenly as can be from every level."""
    order = np.random.default_rng(seed).permutation(len(links))
    level = link_level(links[order])
    rank = np.empty(len(order), dtype=np.int64)
    for k in np.unique(level):
        rank[level == k] = np.arange((level == k).sum())
    return order[np.argsort(rank, kind="stable")[:rows]]


def local_roots(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the smallest node reachable by links (a, b), as positions into ``nodes``."""
    label = nodes.copy()
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        at = np.searchsorted(nodes, low)
        low = np.minimum(low, low[at])
        if (low == label).all():
            return label
        label = low


class _Shard:
    """One shard: collects its own vectors, then answers queries."""

    def __init__(self, threshold: float, beam: int):
        self.threshold, self.beam, self.asked_beam, self.graph, self.parts, self.closed = threshold, beam, beam, None, [], False

    def add(self, nodes: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> None:
        self.parts.append((nodes, weights, vectors))

    def close(self, report: bool) -> pa.RecordBatch | None:
        """Builds the graph and answers the shard's own vectors (told only in one of the shard's tasks)."""
        self.closed = True
        if not self.parts:  # no vectors of this length here
            return None
        nodes, weights, vectors = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        order = np.argsort(nodes)
        nodes, weights, vectors = nodes[order], weights[order], vectors[order]
        self.graph = Graph(vectors)
        self.place = self.graph.order
        self.weights = weights
        self.beam, self.recall = self.graph.audited_beam(self.threshold, self.beam)
        q, n = self.graph.links_of(unit(vectors), self.threshold, self.beam)
        n = self.place[n]
        q, n = q[q != n], n[q != n]
        self.roots = local_roots(nodes, q, n)
        return self._tell(nodes, q, n) if report else self._tell(nodes, q[:0], n[:0])

    def answer(self, nodes: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch | None:
        if not self.graph:
            return None
        exact = unit(vectors)
        q, n = self.graph.links_of(exact, self.threshold, self.asked_beam)
        links = np.bincount(q, minlength=len(exact))
        linked = np.flatnonzero(links)
        sample = np.unique(np.concatenate((np.random.default_rng(19).permutation(len(exact))[:AUDIT_ASKED], linked[spread(links[linked], AUDIT_ASKED, 23)])))
        beam, recall = self.graph.audit(exact[sample], None, self.threshold, self.asked_beam)
        self.recall = min(self.recall, recall)
        if beam > self.asked_beam:
            self.asked_beam = beam
            q, n = self.graph.links_of(exact, self.threshold, beam)
        return self._tell(nodes, q, self.place[n])

    def _tell(self, nodes: np.ndarray, q: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Links and roots of each node that has some, with the recall of the audits so far; without links, a row for that alone."""
        if not len(q):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((None, pa.int64()), (0, pa.int64()), (None, pa.int64()), (self.recall, pa.float64()))], names=["node", "links", "root", "recall"])
        count = np.bincount(q, weights=self.weights[n], minlength=len(nodes)).astype(np.int64)
        pairs = np.unique(np.stack((q, self.roots[n]), axis=1), axis=0)
        first = np.concatenate(([True], pairs[1:, 0] != pairs[:-1, 0]))
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[pairs[:, 0]]), pa.array(np.where(first, count[pairs[:, 0]], 0)), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), self.recall))],
            names=["node", "links", "root", "recall"],
        )


def search_shards(threshold: float, beam: int):
    """A function over Arrow batches (task, kind, block, node, w, vec), sorted by (task, kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            task, kind, block, nodes, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            vec = batch.column(5)
            dims = np.diff(vec.offsets.to_numpy())
            values = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            place = np.concatenate(([0], np.cumsum(dims)))
            cuts = np.flatnonzero(np.concatenate(([True], (task[1:] != task[:-1]) | (kind[1:] != kind[:-1]), [True])))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if at != task[s]:
                    if shard and not shard.closed and (out := shard.close(first)):
                        yield out
                    shard, at, first = _Shard(threshold, beam), task[s], block[s] == 0
                own = values[place[s] : place[e]].reshape(e - s, dims[s])
                if kind[s] == 0:
                    shard.add(nodes[s:e], w[s:e], own)
                else:
                    if not shard.closed and (out := shard.close(first)):
                        yield out
                    if out := shard.answer(nodes[s:e], own):
                        yield out
        if shard and not shard.closed and (out := shard.close(first)):
            yield out

    return run


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    shards: int = SHARDS,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    beam: int = BEAM,
) -> DataFrame:
    """(id, n_links, component_id, audited_recall): one row per row of ``table``.

    Two rows are linked when the cosine of their vectors in double precision is at least ``threshold``. Equal vectors are
    one node of the graph and are all linked. A vector that is null, empty, zero, or holds null or non-finite components
    links with nothing, nor do vectors of different lengths. A component is named by its smallest id (null ids count
    as none; a component of these alone has a null name). Repeated rows are vectors of their own. An empty table gives
    an empty result; other columns are not read. ``audited_recall`` is the same in every row: the least that an audit of a shard or
    of a batch of its questions has measured (null without vectors).
    """
    vec = F.col(vector_col)
    rows = materialize(table.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), vec.alias("vec")))
    finite = "exists(vec, x -> x <> 0) and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    usable = rows.where(f"vec is not null and size(vec) > 0 and coalesce({finite}, false)")
    nodes = materialize(usable.groupBy("vec").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("w")))
    n, longest = nodes.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    shard_rows = max(1, min(shard_rows, SHARD_BYTES // (12 * (longest or 1))))
    shards = max(shards, math.ceil(n / shard_rows)) if n else 1
    blocks = max(1, math.ceil(n / query_rows))
    base = nodes.withColumn("shard", F.pmod(F.xxhash64("node", F.size("vec")), F.lit(shards)).cast("int"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = base.select("shard", every(blocks).alias("block"), F.lit(0).alias("kind"), "node", "w", "vec")
    others = base.select(F.col("shard").alias("home"), every(shards).alias("shard"), F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), "node", "w", "vec")
    asked = own.unionByName(others.where("home <> shard").select("shard", "block", F.lit(1).alias("kind"), "node", "w", "vec"))
    place = F.col("shard") * blocks + F.col("block")
    task = F.size("vec").cast("long") * shards * blocks + place
    rows_in = asked.select(task.alias("task"), "kind", "block", "node", "w", "vec", place.cast("int").alias("place"))
    dealt = rows_in.repartitionById(shards * blocks, F.col("place")).drop("place").sortWithinPartitions("task", "kind")
    answers = materialize(dealt.mapInArrow(search_shards(threshold, beam), "node long, links long, root long, recall double"))
    recall = answers.agg(F.min("recall")).first()[0]
    found = answers.where("node is not null")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"))
    named = materialize(nodes.join(counts, "node", "left").join(joined, nodes["node"] == joined["v"], "left").select("vec", "w", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("c", "node").alias("c")))
    of_rows = materialize(usable.join(named, "vec").select("uid", "id", (F.col("links") + F.col("w") - 1).alias("n_links"), "c"))
    smallest = materialize(of_rows.groupBy("c").agg(F.min("id").alias("component_id")))
    linked = of_rows.join(broadcast_if_small(smallest), "c").select("uid", "n_links", "component_id")
    return rows.select("uid", "id").join(linked, "uid", "left").select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.lit(recall).cast("double").alias("audited_recall"),
    )

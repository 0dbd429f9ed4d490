"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by their membership pattern (the set of sources that list them). In the flow network, a
pattern may send its words once at cost 0, a second time at cost 1, a third time at cost 2 and so on (convex
repetition costs), to any of its sources; each source takes up to its target. As only the repetition arcs cost
anything, filling them level by level with augmenting paths is a minimum-cost flow. Each pattern then takes whole
passes over its documents, and a seeded choice of documents for what remains.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import broadcast_if_small, materialize

#: Membership patterns that the driver holds whole, the largest ones; see ``fold_patterns`` for the others.
MAX_PATTERNS = 200_000
MAX_REPEATS = 3


def capped_shares(sizes: dict, weights: dict, max_repeats: int = MAX_REPEATS) -> dict:
    """Target of each source: its share by weight of all sizes, at most ``max_repeats`` times its size; what is above
    goes to the others by weight, until none is above. Sources are filled in order of size / weight."""
    left, weight, targets, capped = float(sum(sizes.values())), float(sum(weights[s] for s in sizes)), {}, True
    for s in sorted(sizes, key=lambda s: max_repeats * sizes[s] / weights[s]):
        share, most = left * weights[s] / weight, float(max_repeats * sizes[s])
        capped = capped and most <= share
        targets[s] = most if capped else share
        if capped:
            left, weight = left - most, weight - weights[s]
    return targets


class Flow:
    """Integer maximum flow by shortest augmenting paths; capacities may grow between runs."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.left: list[int] = []
        self.out: dict[int, list[int]] = {}

    def arc(self, a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.left.append(c)
        return len(self.to) - 2

    def fill(self, source: int, sink: int) -> None:
        """Dinic: levels by breadth first, then blocking flows along them."""
        while True:
            level, queue = {source: 0}, deque([source])
            while queue:
                x = queue.popleft()
                for e in self.out.get(x, ()):
                    if self.left[e] and self.to[e] not in level:
                        level[self.to[e]] = level[x] + 1
                        queue.append(self.to[e])
            if sink not in level:
                return
            place = dict.fromkeys(level, 0)
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    push = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= push
                        self.left[e ^ 1] += push
                    path, x = [], source
                    continue
                arcs = self.out.get(x, ())
                while place[x] < len(arcs):
                    e = arcs[place[x]]
                    if self.left[e] and level.get(self.to[e]) == level[x] + 1:
                        break
                    place[x] += 1
                if place[x] < len(arcs):
                    path.append(arcs[place[x]])
                    x = self.to[path[-1]]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    place[x] += 1
                else:
                    break


def min_cost_mix(patterns: dict[tuple, int], targets: dict, max_repeats: int = MAX_REPEATS) -> dict[tuple, dict]:
    """pattern -> {source: words}: fills the targets with the fewest repetitions."""
    flow, node = Flow(), {("source", s): i + 2 for i, s in enumerate(targets)}
    node |= {("pattern", p): len(node) + 2 + i for i, p in enumerate(patterns)}
    for s, target in targets.items():
        flow.arc(node["source", s], 1, int(target + 0.5))
    levels = {p: flow.arc(0, node["pattern", p], 0) for p in patterns}
    routes = {(p, s): flow.arc(node["pattern", p], node["source", s], max_repeats * size) for p, size in patterns.items() for s in p}
    for _ in range(max_repeats):  # each level costs one more than the last
        for p, size in patterns.items():
            flow.left[levels[p]] += size
        flow.fill(0, 1)
    return {p: {s: flow.left[routes[p, s] ^ 1] for s in p} for p in patterns}


def fold_patterns(rows: DataFrame, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """``rows`` with at most ``max_patterns`` patterns (sources) of several sources: the documents of smaller patterns are dealt to
    one of their sources each, by a hash of the id. All of them stay in the mix; only their choice of source is made beforehand."""
    sizes = materialize(rows.where("size(sources) > 1").groupBy("sources").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")))
    if sizes.count() <= max_patterns:
        return rows
    whole = materialize(sizes.orderBy(F.desc("n"), F.desc("rows"), "sources").limit(max_patterns).select(F.col("sources").alias("p"), F.lit(True).alias("whole")))
    one = F.array(F.get("sources", F.pmod(F.xxhash64("h"), F.size("sources")).cast("int")))
    folded = F.when(F.col("whole") | (F.size("sources") < 2), F.col("sources")).otherwise(one)
    return rows.join(broadcast_if_small(whole), F.col("sources") == F.col("p"), "left").withColumn("sources", folded).drop("p", "whole")


def mix(
    docs: DataFrame,
    targets: Callable[[dict], dict],
    id_col: str = "doc_id",
    size_col: str = "size",
    sources_col: str = "sources",
    seed: str = "mix",
    max_repeats: int = MAX_REPEATS,
    max_patterns: int = MAX_PATTERNS,
) -> tuple[DataFrame, dict, dict]:
    """((uid, id, size, sources, repeats), source sizes, source targets): one row per row of ``docs``.

    ``targets`` gets {source: words of the documents that list it} and returns {source: words wanted}. ``sources`` is an
    array; null inside it is a source like any other. A row without sources, or of size 0, is never taken. Within a
    pattern documents are taken in the order of a seeded hash; the one at the end is exchanged for the document that
    comes nearest the remainder, so a source misses its target by less than a document. Sizes that are null count
    as 0; repeated rows are documents of their own; an empty table gives an empty result. The driver holds a row for each source
    and each pattern; ``sources`` of the result are those of ``fold_patterns``.
    """
    listed = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col(id_col).alias("id"),
            F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"),
            F.array_sort(F.array_distinct(F.coalesce(F.col(sources_col), F.array().cast("array<string>")))).alias("sources"),
        ).withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"), F.col("size").cast("string"))))
    )
    rows = fold_patterns(listed, max_patterns)
    spark = rows.sparkSession
    sizes = {tuple(r["sources"]): r["n"] for r in rows.groupBy("sources").agg(F.sum("size").alias("n")).collect()}
    by_source: dict = {}
    for p, n in sizes.items():
        for s in p:
            by_source[s] = by_source.get(s, 0) + n
    wanted = targets(by_source)
    routed = min_cost_mix(sizes, wanted, max_repeats)
    taken = {p: sum(routed[p].values()) for p in sizes}
    plan = [(list(p), taken[p] // n if n else 0, taken[p] % n if n else 0) for p, n in sizes.items()]
    plans = F.broadcast(spark.createDataFrame(plan, "p array<string>, passes long, rest long"))

    # the bucket of the hash order in which each pattern's remainder ends
    bucket = F.substring("h", 1, 3)
    sums = rows.groupBy("sources", bucket.alias("b")).agg(F.sum("size").alias("n"))
    end = F.sum("n").over(W.partitionBy("sources").orderBy("b"))
    edges = (
        sums.select("sources", "b", end.alias("end"), (end - F.col("n")).alias("start"))
        .join(plans, F.col("sources").eqNullSafe(F.col("p")))
        .where("start <= rest and rest < end")
        .select(F.col("sources").alias("e"), F.col("b").alias("edge"), "start")
    )
    plan = materialize(plans.join(edges, F.col("p").eqNullSafe(F.col("e")), "left").drop("e"))
    marked = rows.join(F.broadcast(plan), F.col("sources").eqNullSafe(F.col("p"))).drop("p")
    inner = marked.where(bucket.eqNullSafe(F.col("edge")))
    upto = F.sum("size").over(W.partitionBy("sources").orderBy("h", "uid").rowsBetween(W.unboundedPreceding, 0)) + F.col("start")
    picked = materialize(
        marked.where(~bucket.eqNullSafe(F.col("edge")))
        .withColumn("picked", F.coalesce(bucket < F.col("edge"), F.lit(False)))
        .unionByName(inner.withColumn("picked", upto <= F.col("rest")))
        .select("uid", "id", "size", "sources", "h", "passes", "rest", "picked")
    )
    # one more document: of those not picked, the one whose size comes nearest what is missing
    missing = F.broadcast(
        picked.groupBy("sources", "rest").agg(F.sum(F.when(F.col("picked"), F.col("size")).otherwise(0)).alias("got")).select(F.col("sources").alias("s"), (F.col("rest") - F.col("got")).alias("gap"))
    )
    best = (
        picked.where("not picked and size > 0")
        .join(missing, F.col("sources").eqNullSafe(F.col("s")))
        .withColumn("off", F.abs(F.col("size") - F.col("gap")))
        .where("off < gap")
        .groupBy("sources")
        .agg(F.min(F.struct("off", "h", "uid")).alias("best"))
        .select(F.col("best.uid").alias("extra"))
    )
    repeats = F.col("passes") + (F.col("picked") | F.col("extra").isNotNull()).cast("long")
    chosen = picked.join(F.broadcast(best), F.col("uid") == F.col("extra"), "left").select(
        "uid", "id", "size", "sources", F.when(F.col("size") > 0, repeats).otherwise(0).alias("repeats")
    )
    return chosen, by_source, wanted


def mix_documents(
    docs: DataFrame,
    targets: Callable[[dict], dict],
    size: Column,
    sources: Column,
    id_col: str = "doc_id",
    seed: str = "mix",
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with its columns, each as often as it is repeated. Rules as in ``mix``."""
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("k_id"), F.coalesce(size, F.lit(0)).cast("long").alias("k_size"), sources.alias("k_sources"))
    marked = marked.withColumn("k_sources", F.array_sort(F.array_distinct(F.coalesce("k_sources", F.array().cast("array<string>")))))
    chosen, _, _ = mix(marked, targets, "k_id", "k_size", "k_sources", seed, max_repeats)
    # rows that share id, size and sources share their repeats evenly; what is over goes to the first of them
    plan = materialize(
        chosen.groupBy("id", "size", "sources").agg(F.count(F.lit(1)).alias("n"), F.sum("repeats").alias("times")).where("times > 0")
    )
    same = F.col("k_id").eqNullSafe(F.col("id")) & (F.col("k_size") == F.col("size")) & F.col("k_sources").eqNullSafe(F.col("sources"))
    even = marked.join(broadcast_if_small(plan.where("times % n = 0")), same).withColumn("each", F.expr("times div n"))
    uneven = plan.where("times % n > 0")
    taken = even.select("row", "each")
    if uneven.limit(1).count():
        nth = F.row_number().over(W.partitionBy("id", "size", "sources").orderBy(F.xxhash64("row")))
        odd = marked.join(broadcast_if_small(uneven), same).withColumn("each", F.expr("times div n") + (nth <= F.expr("times % n")).cast("long"))
        taken = taken.unionByName(odd.select("row", "each"))
    return taken.where("each > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("each").cast("int")))).select("row.*")

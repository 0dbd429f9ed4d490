"""Sharding by a minimax contiguous partition, in DataFrame and SQL functions only.

Equal texts form an atomic group. Groups are ordered by (size, digest) and cut into ``n_shards`` contiguous runs so
that the largest shard is as small as possible: a binary search finds the smallest capacity that a greedy pass
over the ordered sizes can meet, and the greedy pass at that capacity makes the cuts.

Because the order starts with the size, the greedy pass needs only the histogram of group sizes: a run of n equal
sizes is passed in one step. D different sizes add up to at least D * D / 2 bytes, so a corpus of T bytes has at
most sqrt(2 * T) of them; that bounds what the search holds. At most ``n_shards - 1`` sizes are cut inside their
run, and only groups of these sizes are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import materialize

#: Bytes counted for each row on top of its text.
ROW_BYTES = 16
#: Sub-buckets that split the numbering of one shard, or of one cut size, over tasks.
BUCKETS = 1024


def _pass(runs: str, capacity: str, step: str, start: str) -> str:
    """SQL for a greedy pass: folds ``step`` over the runs; in it, fit is what still goes into the open shard."""
    return f"aggregate({runs}, {start}, (a, r) -> {step.replace('FIT', f'(({capacity} - a.used) div r.size)').replace('PER', f'({capacity} div r.size)')})"


def capacity_sql(runs: str, n_shards: int) -> str:
    """SQL for the smallest feasible capacity over the sorted array ``runs`` of struct(size, n)."""
    after = "(r.n - FIT)"
    step = (
        "if(r.n <= FIT, named_struct('shards', a.shards, 'used', a.used + r.n * r.size), "
        f"named_struct('shards', a.shards + ({after} + PER - 1) div PER, 'used', (({after} - 1) % PER + 1) * r.size))"
    )
    count = _pass(runs, "m", step, "named_struct('shards', 1L, 'used', 0L)")
    total = f"aggregate({runs}, 0L, (t, r) -> t + r.n * r.size)"
    largest = f"element_at({runs}, -1).size"
    even = f"(({total} + {n_shards - 1}) div {n_shards})"
    halve = (
        f"if(b.lo >= b.hi, b, transform(array((b.lo + b.hi) div 2), m -> "
        f"if({count}.shards <= {n_shards}, named_struct('lo', b.lo, 'hi', m), named_struct('lo', m + 1L, 'hi', b.hi)))[0])"
    )
    bounds = f"named_struct('lo', greatest({even}, {largest}), 'hi', {even} + {largest})"
    return f"aggregate(sequence(1, 64), {bounds}, (b, i) -> {halve}).lo"


def cuts_sql(runs: str, capacity: str) -> str:
    """SQL for where each shard after the first starts: array of struct(size, nth), nth from 0 in the run of that size."""
    after = "(r.n - FIT)"
    step = (
        "if(r.n <= FIT, named_struct('used', a.used + r.n * r.size, 'cuts', a.cuts), "
        f"named_struct('used', (({after} - 1) % PER + 1) * r.size, 'cuts', concat(a.cuts, "
        f"transform(sequence(0L, ({after} + PER - 1) div PER - 1), j -> named_struct('size', r.size, 'nth', FIT + j * PER)))))"
    )
    none = "cast(array() as array<struct<size:bigint,nth:bigint>>)"
    return _pass(runs, capacity, step, f"named_struct('used', 0L, 'cuts', {none})") + ".cuts"


def minimax_cuts(groups: DataFrame, n_shards: int) -> DataFrame:
    """One row (capacity, cuts) for ``groups`` (gsize); no row for an empty table."""
    hist = groups.groupBy("gsize").agg(F.count(F.lit(1)).alias("n"))
    runs = hist.agg(F.array_sort(F.collect_list(F.struct(F.col("gsize").alias("size"), "n"))).alias("runs")).where("size(runs) > 0")
    return runs.selectExpr("runs", f"{capacity_sql('runs', n_shards)} as capacity").selectExpr(
        "capacity", f"{cuts_sql('runs', 'capacity')} as cuts"
    )


def number_within(df: DataFrame, by: list[str], order: list[str], bucket: str, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... within ``by``, ordered by (bucket, order). Counts of buckets give each one its start,
    so no task numbers a whole group."""
    group, keys = W.partitionBy(*by), [*by, bucket]
    before = F.sum("__n").over(group.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    starts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(*keys, F.coalesce(before, F.lit(0)).alias("__start"))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).join(starts, keys).withColumn(name, F.col("__start") + F.col("__nth") - 1).drop("__start", "__nth")


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, digest, shard, slot): one row per row of ``docs``.

    A row's size is its text's UTF-8 bytes plus ``ROW_BYTES``; a null text has no bytes and is in one group with
    empty texts. Equal texts share a shard. Shards are contiguous in (group size, digest), the largest is as small
    as any such cut allows, and with few groups the last shards may stay empty. ``slot`` numbers a shard's rows
    from 0 without gaps, by a hash of the id; ids may be null or repeat (repeated rows take slots of their own).
    An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        )
    )
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("gsize")))
    cuts = materialize(minimax_cuts(groups, n_shards))
    found = cuts.select("cuts").first()
    starts = [(c["size"], c["nth"]) for c in found[0]] if found else []  # at most n_shards - 1
    inside = sorted({s for s, nth in starts if nth > 0})
    is_cut = F.col("gsize").isin(inside) if inside else F.lit(False)
    ranked = number_within(
        groups.where(is_cut).withColumn("__b", F.conv(F.substring(F.hex("digest"), 1, 3), 16, 10).cast("int")), ["gsize"], ["digest"], "__b", "nth"
    ).drop("__b")
    placed = groups.where(~is_cut).withColumn("nth", F.lit(0).cast("long")).unionByName(ranked.withColumn("nth", F.col("nth").cast("long")))
    where = F.lit(0)
    for s, nth in starts:
        where = where + ((F.col("gsize") > s) | ((F.col("gsize") == s) & (F.col("nth") >= nth))).cast("int")
    assigned = materialize(rows.join(placed.select("digest", where.alias("shard")), "digest"))
    salted = assigned.withColumn("__b", F.pmod(F.xxhash64("id", "digest"), F.lit(BUCKETS)).cast("int"))
    order = ["id", "digest"]
    return number_within(salted, ["shard"], order, "__b", "slot").select(
        "id", "size", "text_crc32", "digest", "shard", F.col("slot").cast("long").alias("slot")
    )

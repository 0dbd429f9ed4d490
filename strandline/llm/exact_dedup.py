"""Exact dedup by a heavy-hitter split.

A Misra-Gries summary of each partition finds the digests that may hold more than ``heavy_fraction`` of all
rows. Their exact counts and winners are verified in one aggregation and broadcast, so that losing rows of a
large group leave on the map side. All other rows are shuffled by digest, in groups known to be small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import lower_ascii, materialize

#: A digest with at least this share of the rows is heavy.
HEAVY_FRACTION = 1 / 1024


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256))


def misra_gries(counters: dict, seen: pd.Series, k: int) -> dict:
    """Adds a batch of counts to at most k counters; each is short by at most rows / (k + 1)."""
    for key, n in seen.items():
        counters[key] = counters.get(key, 0) + int(n)
    if len(counters) > k:
        cut = sorted(counters.values(), reverse=True)[k]
        counters = {key: n - cut for key, n in counters.items() if n > cut}
    return counters


def heavy_digests(digests: DataFrame, heavy_fraction: float = HEAVY_FRACTION) -> DataFrame:
    """(digest): every digest with at least ``heavy_fraction`` of the rows, 2 / heavy_fraction rows at most.

    A partition of n rows drops counters under heavy_fraction * n / 4, and Misra-Gries with 4 / heavy_fraction
    counters loses as much again, so a sum is short by at most half the threshold, and half of it is asked for.
    """
    k = int(4 / heavy_fraction)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters: dict = {}
        rows = 0
        for batch in batches:
            rows += len(batch)
            counters = misra_gries(counters, batch["digest"].value_counts(), k)
        kept = [(d, n) for d, n in counters.items() if n >= heavy_fraction * rows / 4]
        yield pd.DataFrame({"digest": [d for d, _ in kept], "n": [n for _, n in kept], "rows": [0] * len(kept)})
        yield pd.DataFrame({"digest": [None], "n": [0], "rows": [rows]})

    parts = materialize(digests.select("digest").mapInPandas(summarise, "digest binary, n long, rows long"))
    total = parts.agg(F.sum("rows")).first()[0] or 0
    return (
        parts.where("digest is not null")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= max(2, heavy_fraction * total / 2))
        .select("digest")
    )


def heavy_winners(digests: DataFrame, heavy_fraction: float = HEAVY_FRACTION) -> DataFrame:
    """(digest, heavy_keep, heavy_size), exact, for the heavy digests; 2 / heavy_fraction rows at most."""
    candidates = materialize(heavy_digests(digests, heavy_fraction))
    return materialize(
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.max("id").alias("heavy_keep"), F.count(F.lit(1)).alias("heavy_size"))
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_fraction: float = HEAVY_FRACTION
) -> DataFrame:
    """(id, keep_id, group_size, kept, digest): one row per row of ``docs``, dropped ones too.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts are one
    group. The row with the largest id stays (a null id loses to any other; where all ids are null, keep_id is
    null and one row stays). Of repeated rows with the winning id exactly one is kept. An empty table gives an
    empty result. Other columns are not read, whatever their names.
    """
    digests = materialize(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")))
    winners = heavy_winners(digests, heavy_fraction)
    rows = digests.join(F.broadcast(winners), "digest", "left")
    lost = F.col("heavy_size").isNotNull() & ~F.col("id").eqNullSafe(F.col("heavy_keep"))
    removed = rows.where(lost).select(
        "id", F.col("heavy_keep").alias("keep_id"), F.col("heavy_size").alias("group_size"), F.lit(False).alias("kept"), "digest"
    )
    group = W.partitionBy("digest")
    shuffled = rows.where(~lost).select(
        "id",
        F.coalesce("heavy_keep", F.max("id").over(group)).alias("keep_id"),
        F.coalesce("heavy_size", F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.desc_nulls_last("id"))) == 1).alias("kept"),
        "digest",
    )
    return removed.unionByName(shuffled)


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_fraction: float = HEAVY_FRACTION
) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns. Same rules as ``exact_groups``."""
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"))
    digests = materialize(marked.select("id", "digest"))
    winners = heavy_winners(digests, heavy_fraction)
    candidates = marked.join(F.broadcast(winners), "digest", "left").where(
        F.col("heavy_size").isNull() | F.col("id").eqNullSafe(F.col("heavy_keep"))
    )
    first = F.row_number().over(W.partitionBy("digest").orderBy(F.desc_nulls_last("id")))
    return candidates.select("row", first.alias("nth")).where("nth = 1").select("row.*")

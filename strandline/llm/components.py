"""Connected components of a link table by label propagation with pointer jumping, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize, release


def connected_components(links: DataFrame) -> DataFrame:
    """(v, c) for every end of ``links`` (a, b: long): c is the smallest end reachable. Repeated links and loops are
    harmless; no links give an empty result. Each round takes the smallest label of the neighbours and then the label's own
    label, so long paths shorten by half a round. Hubs are never gathered: joins may be split, minima are pre-aggregated.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("c").alias("n")), "b").groupBy("a").agg(F.min("n").alias("n"))
        hooked = materialize(labels.join(near.withColumnRenamed("a", "v"), "v").select("v", F.col("c").alias("old"), F.least("c", "n").alias("c")))
        jumped = hooked.join(hooked.select(F.col("v").alias("c"), F.col("c").alias("up")), "c").select("v", "old", F.least("c", "up").alias("c"))
        after = materialize(jumped)
        moved = after.where("c <> old").limit(1).count()
        release(labels, hooked)
        labels = after.select("v", "c")
        labels._materialized = after._materialized
        if not moved:
            release(both)
            return labels

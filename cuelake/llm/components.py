"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, root): root is the smallest node reachable.

    Each round hooks every node's neighbours to its smallest neighbour (Kiveris
    et al., "Connected Components in MapReduce and Beyond"); edges never grow in
    number and the table is rewritten in the shared folder each round, until a
    round changes nothing.  Loops and null ends are ignored.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        changed = new.join(now, ["u", "v"], "left_anti").limit(1).count() or new.count() != now.count()
        drop_cut(now)
        now = new
        if not changed:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())

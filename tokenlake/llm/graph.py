"""Connected components of a link table, in Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, root) of every node that has a link: root is the smallest node of its component.

    edges: (a, b) long, either direction, repeated or not; links of a node to itself and links with a null say nothing.
    Alternates large-star and small-star steps, which take O(log^2) rounds.  The minimum of a node's neighbours is an ordinary aggregate
    (combined before the shuffle) joined back, so a hub is never gathered in one task.  Each round's lineage ends in a
    reliable checkpoint.
    """
    pair = lambda a, b: [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]
    held = edges.where("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct().checkpoint()
    seen = None
    for _ in range(most):
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(*pair(F.col("a"), F.col("b"))).distinct()
        low = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = down.join(low, down["a"] == low["u"]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        held = small.where("a <> b").distinct().checkpoint()
        now = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

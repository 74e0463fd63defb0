"""Connected components of a link table by alternating large and small stars, distributed, with a checkpoint each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, parts_for


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b longs, a != b); root is the smallest node of the component.

    An empty table gives an empty result; repeated links count once; null ends must be taken out before.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    # a table of few links takes few tasks, however wide other shuffles are
    few = parts_for(2 * edges.count())
    edges = edges.coalesce(few)
    state = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(few)
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").coalesce(few).distinct().coalesce(few)
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(least.select("u", F.col("m").alias("v"))).coalesce(few).distinct()
        edges = checkpointed(small.coalesce(few))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())

"""Connected components in DataFrame operations: alternating large-star and small-star rounds.

Each round is two joins and two partial aggregations, written to the shared folder, so lineage stays short and a hub
is pre-aggregated before the shuffle and split by adaptive execution in the join. Nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, comp`` for every node of an edge: the smallest node that it reaches.

    Null ends, loops and repeated edges add nothing; no edges give no rows.
    """
    low, high = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    now = saved(edges.filter(F.col(a) != F.col(b)).select(high, low).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or not mark.n:
            break
        before = mark
        # Large star: what is above a node hangs on the least node around it.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        now = saved(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # Small star: a node and what is below it hang on the least of them.
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        down = now.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())

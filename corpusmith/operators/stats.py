"""Statistics of clusters over assignments (``idx, cluster, distance``), thresholds and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shortened, truncated

DIGITS = 6


def cluster_stats(assignments: DataFrame, k: int | None = None) -> DataFrame:
    """``cluster, total_examples, sum_distance, average_distance``; with ``k``, clusters 0 to k - 1 all have a row, an
    empty one with zeros. The average distance is what quotas call density."""
    s = assignments.groupBy("cluster").agg(F.count("*").alias("total_examples"), F.round(F.sum("distance"), DIGITS).alias("sum_distance"))
    if k is not None:
        s = s.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster")).join(s, "cluster", "left")
    n, total = F.coalesce("total_examples", F.lit(0).cast("long")), F.coalesce("sum_distance", F.lit(0.0))
    return s.select("cluster", n.alias("total_examples"), total.alias("sum_distance"), F.coalesce(F.round(F.try_divide(total, n), DIGITS), F.lit(0.0)).alias("average_distance"))


def extremes(assignments: DataFrame, docs: DataFrame, n: int = 5, chars: int = 256) -> DataFrame:
    """The ``n`` closest and farthest documents of each cluster with the head of their texts, a row each.

    Ranks are found on narrow rows, with the rank's bound known to the optimizer; texts are joined last.
    """
    near = Window.partitionBy("cluster").orderBy("distance", "idx")
    far = Window.partitionBy("cluster").orderBy(F.desc("distance"), "idx")
    a = assignments.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= n).withColumn("side", F.lit("closest"))
    b = assignments.withColumn("rank", F.row_number().over(far)).filter(F.col("rank") <= n).withColumn("side", F.lit("farthest"))
    return a.unionByName(b).join(docs.select("idx", truncated(F.col("text"), chars).alias("text")), "idx").select("cluster", "side", "rank", "idx", "distance", "text")


def inspect(examples: DataFrame, chars: int = 512) -> DataFrame:
    """What a person reads to judge clusters: the examples shortened."""
    return examples.select("cluster", "side", "rank", shortened(F.col("text"), chars).alias("shown"))


def thresholds(assignments: DataFrame, m: int) -> DataFrame:
    """``cluster, threshold``: the distance at 0-based rank ``min(m, n - 1)`` of the cluster's sorted distances."""
    ranked = assignments.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "idx")))
    return ranked.filter(F.col("rank") <= m + 1).groupBy("cluster").agg(F.max("distance").alias("threshold"))


def threshold_mask(assignments: DataFrame, m: int, excluded: list[int]) -> DataFrame:
    """``idx, cluster, keep``: kept are distances up to the cluster's threshold (so at least m + 1 rows, and ties),
    unless the cluster is excluded."""
    joined = assignments.join(thresholds(assignments, m), "cluster", "left")
    keep = F.coalesce(F.col("distance") <= F.col("threshold"), F.lit(False)) & ~F.coalesce(F.col("cluster").isin(*excluded), F.lit(False))
    return joined.select("idx", "cluster", keep.alias("keep"))


def mask_metadata(mask: DataFrame) -> DataFrame:
    """``total_examples, kept_examples, percentage_kept``; nothing selected of nothing is 0 percent."""
    s = mask.agg(F.count("*").alias("total_examples"), F.coalesce(F.sum(F.col("keep").cast("long")), F.lit(0)).alias("kept_examples"))
    share = F.try_divide(F.col("kept_examples").cast("double"), F.col("total_examples")) * 100
    return s.withColumn("percentage_kept", F.coalesce(F.round(share, DIGITS), F.lit(0.0)))


def assignment_metadata(assignments: DataFrame, chunk_size: int, prefix: str = "cluster_results") -> DataFrame:
    """One row about the chunks that the assignments fill."""
    n = assignments.agg(F.count("*").alias("total_entries"))
    return n.select(F.expr(f"(total_entries + {chunk_size - 1}) div {chunk_size}").alias("total_chunks"), F.lit(chunk_size).cast("long").alias("chunk_size"), F.lit(prefix).alias("prefix"), "total_entries")

"""Sampling and splitting by a hash order: the same rows whatever the partitioning, and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

TRAIN, VALIDATION = 0.9896091, 0.009896091


def order_key(purpose: str, seed: int = 42, idx: str = "idx") -> Column:
    """A pseudorandom key of a row, another for each purpose."""
    return F.md5(F.concat(F.lit(f"{seed}:{purpose}:"), F.col(idx).cast("string")).cast("binary"))


def stratified(assignments: DataFrame, quotas: DataFrame, quota: str = "actual", purpose: str = "sample", seed: int = 42) -> DataFrame:
    """As many rows of each cluster as its quota says, without replacement.

    The largest quota is written into the plan, so every task cuts its rows to it before the shuffle; a cluster
    without a quota gives none. Quotas are a model-sized table.
    """
    return _first(assignments, quotas.select("cluster", F.col(quota).alias("_cs_q")), order_key(purpose, seed), F.col("idx"))


def _first(rows: DataFrame, quotas: DataFrame, *order: Column) -> DataFrame:
    """The first ``_cs_q`` rows of each cluster in an order, columns as they come."""
    most = quotas.agg(F.max("_cs_q")).first()[0] or 0
    ranked = rows.withColumn("_cs_rn", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).filter(F.col("_cs_rn") <= most)
    return ranked.join(quotas, "cluster").filter("_cs_rn <= _cs_q").select(*[F.col(f"`{c}`") for c in rows.columns])


def top_up(assignments: DataFrame, taken: DataFrame, quotas: DataFrame, quota: str = "topup", seed: int = 42) -> DataFrame:
    """More rows of each cluster, none that is already taken."""
    return stratified(assignments.join(taken.select("idx"), "idx", "left_anti"), quotas, quota, "topup", seed)


def top_by_loss(scored: DataFrame, quotas: DataFrame, bottom: float = 0.0) -> DataFrame:
    """The rows of highest loss of each cluster up to its quota; ``bottom``: this share of it from the low end."""
    rows = scored.select("idx", "cluster", "loss")
    share = F.floor(F.col("actual") * F.lit(1 - bottom)) if bottom else F.col("actual")
    top = _first(rows, quotas.select("cluster", share.alias("_cs_q")), F.desc("loss"), F.col("idx"))
    if not bottom:
        return top
    low = _first(rows, quotas.select("cluster", (F.col("actual") - share).alias("_cs_q")), F.col("loss"), F.desc("idx"))
    return top.unionByName(low).distinct()  # a small cluster's rows may be in both ends


def _placed(selected: DataFrame, bounds, seed: int) -> DataFrame:
    """Adds ``split`` from a rank over all selected rows. Ranks come from range partitions: each counts its own rows
    and adds the rows of those before, so that no task sees all of them."""
    # Buckets of the key's first digits; within a bucket the order is exact. The selection is written once.
    key = order_key("split", seed)
    keyed = written(selected.withColumns({"_cs_k": key, "_cs_b": F.conv(F.substring(key, 1, 3), 16, 10).cast("int")}), "selected")
    spark = selected.sparkSession
    sizes = sorted(keyed.groupBy("_cs_b").count().collect())
    n = sum(m for _, m in sizes)
    before, rows = 0, []
    for b, m in sizes:
        rows.append((b, before))
        before += m
    bases = spark.createDataFrame(rows, "_cs_b int, _cs_base long")  # 4096 rows at most
    rank = F.row_number().over(Window.partitionBy("_cs_b").orderBy("_cs_k", "idx")) + F.col("_cs_base")
    ranked = keyed.join(F.broadcast(bases), "_cs_b").withColumn("_cs_r", rank)
    train, validation, test = bounds(n)
    r = F.col("_cs_r")
    split = F.when(r <= train, "train").when(r <= train + validation, "validation").when(r <= train + validation + test, "test")
    return ranked.withColumn("split", split).filter("split is not null").drop("_cs_k", "_cs_b", "_cs_base", "_cs_r")


def split_fixed(selected: DataFrame, train: int, validation: int, test: int, seed: int = 42) -> DataFrame:
    """Fixed sizes in this order; what is left over is dropped."""
    return _placed(selected, lambda n: (train, validation, test), seed)


def split_ratio(selected: DataFrame, train: float = TRAIN, validation: float = VALIDATION, seed: int = 42) -> DataFrame:
    """Shares rounded down; the rest is test."""
    return _placed(selected, lambda n: (int(n * train), int(n * validation), n - int(n * train) - int(n * validation)), seed)


def split_scaled(selected: DataFrame, train: int, validation: int, test: int, seed: int = 42) -> DataFrame:
    """Fixed sizes scaled to the number of rows; the rest is test."""

    def bounds(n: int) -> tuple[int, int, int]:
        s = n / (train + validation + test)
        a, b = int(train * s), int(validation * s)
        return a, b, n - a - b

    return _placed(selected, bounds, seed)

"""How many documents each cluster gives. Every policy maps cluster statistics to ``cluster, quota, actual``:
``actual`` is the quota or the cluster's size, whichever is less; a shortfall is not made up elsewhere.

Statistics have a row per cluster, so windows over all of them are windows over a model-sized table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _all():
    """All rows: of statistics, a row per cluster."""
    return Window.partitionBy()


def not_noise(assignments: DataFrame, noise: int = -1) -> DataFrame:
    """Assignments but those to noise; a null cluster is none either."""
    return assignments.filter(F.col("cluster") != noise)


def check_total(quotas: DataFrame, total: int) -> DataFrame:
    """The quotas, if they are whole, none below zero, and add up to ``total``; else an error."""
    n, least = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.min("quota")).first()
    if n != total or (least is not None and least < 0):
        raise ValueError(f"quotas add up to {n}, not {total}; the least is {least}")
    return quotas


def check_selection(selected: DataFrame, quotas: DataFrame) -> DataFrame:
    """The selection, if no ``idx`` is null, below 0 or chosen twice, and no cluster gives another number than its ``actual``."""
    n, ids, bad = selected.agg(F.count("*"), F.countDistinct("idx"), F.sum((F.coalesce("idx", F.lit(-1)) < 0).cast("int"))).first()
    if n != ids or bad:
        raise ValueError(f"{n} rows with {ids} different ids, {bad or 0} of them invalid")
    sizes = selected.groupBy("cluster").agg(F.count("*").alias("n"))
    off = quotas.select("cluster", "actual").join(sizes, "cluster", "full").filter(F.coalesce("n", F.lit(0)) != F.coalesce("actual", F.lit(0))).limit(1).collect()
    if off:
        raise ValueError(f"cluster {off[0].cluster} gives {off[0].n} rows of {off[0].actual}")
    return selected


def included(stats: DataFrame, excluded: list[int], expected: int | None = None) -> DataFrame:
    """The clusters that are not excluded; ``expected``: so many must be listed, else the list is wrong."""
    if expected is not None and len(set(excluded)) != expected:
        raise ValueError(f"{expected} clusters should be excluded, {len(set(excluded))} are")
    return stats.filter(~F.col("cluster").isin(*excluded)) if excluded else stats


def _out(stats: DataFrame, quota: Column) -> DataFrame:
    q = stats.withColumn("quota", F.greatest(F.floor(F.coalesce(quota, F.lit(0.0))), F.lit(0)).cast("long"))
    return q.select("cluster", "quota", F.least("quota", "total_examples").alias("actual"))


def _share() -> Column:
    return F.try_divide(F.col("total_examples").cast("double"), F.sum("total_examples").over(_all()))


def equal(stats: DataFrame, total: int, excluded: list[int]) -> DataFrame:
    """The same for all; the remainder goes, one each, to the first clusters by number."""
    s = included(stats, excluded)
    n, rank = F.count("*").over(_all()), F.row_number().over(Window.orderBy("cluster"))
    s = s.withColumn("n", n).withColumn("rank", rank)
    return _out(s, F.expr(f"{total} div n + CASE WHEN rank <= {total} % n THEN 1 ELSE 0 END"))


def proportional(stats: DataFrame, total: int, excluded: list[int]) -> DataFrame:
    return _out(included(stats, excluded), F.lit(total) * _share())


def density(stats: DataFrame, total: int, excluded: list[int], omega: float = 0.5) -> DataFrame:
    """By size, times one less ``omega`` times the average distance: sparse clusters give less."""
    return _out(included(stats, excluded), F.lit(total) * _share() * (1 - omega * F.col("average_distance")))


def low_topup(stats: DataFrame, total: int, excluded: list[int], omega: float = 0.75, least: int | None = None) -> DataFrame:
    """:func:`density`, then a top-up towards ``least`` rows: in order of clusters each gives its share by size of
    what is still missing, while that shrinks, as far as it has rows left. Adds column ``topup``."""
    s = included(stats, excluded)
    base = density(stats, total, excluded, omega).join(s.select("cluster", "total_examples", _share().alias("share")), "cluster")
    row = F.struct("cluster", "actual", "total_examples", "share")
    one = base.agg(F.sort_array(F.collect_list(row)).alias("rows"), F.sum("actual").alias("given"))
    goal = total if least is None else least
    start = F.struct(F.greatest(F.lit(goal) - F.col("given"), F.lit(0)).cast("long").alias("left"), F.array().cast("array<struct<cluster:int,topup:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.least(F.floor(acc["left"] * x["share"]), x["total_examples"] - x["actual"]).cast("long")
        more = F.when(acc["left"] > 0, more).otherwise(F.lit(0).cast("long"))
        return F.struct((acc["left"] - more).alias("left"), F.concat(acc["out"], F.array(F.struct(x["cluster"].cast("int").alias("cluster"), more.alias("topup")))).alias("out"))

    tops = one.select(F.inline(F.aggregate("rows", start, step)["out"]))
    return base.join(tops, "cluster").select("cluster", "quota", "actual", "topup")


def loss_proportions(losses: DataFrame, total: int) -> DataFrame:
    """``cluster, mean_loss, proportion``: the total dealt by mean loss."""
    share = F.try_divide(F.col("mean_loss"), F.sum("mean_loss").over(_all()))
    return losses.select("cluster", "mean_loss", F.round(share * total, 6).alias("proportion"))


def loss_quota(proportions: DataFrame, stats: DataFrame) -> DataFrame:
    """Proportions rounded half to even, at most the cluster's size."""
    q = proportions.select("cluster", F.bround("proportion").cast("long").alias("quota"))
    return q.join(stats.select("cluster", "total_examples"), "cluster").select("cluster", "quota", F.least("quota", "total_examples").alias("actual"))


def inter(stats: DataFrame, diversity: DataFrame, total: int, excluded: list[int], weights: tuple[float, float, float] = (0.33, 0.33, 0.33)) -> DataFrame:
    """By a score of size share, closeness and distance to the other centroids, with these weights. The mean distance
    counts excluded centroids too; the greatest one, by which it is scaled, does not."""
    size, close, apart = weights
    s = included(stats, excluded).join(diversity, "cluster")
    score = size * _share() + close * (1 - F.col("average_distance")) + apart * F.try_divide(F.col("diversity"), F.max("diversity").over(_all()))
    s = s.withColumn("score", F.round(score, 9))
    return _out(s, F.lit(total) * F.try_divide(F.col("score"), F.sum("score").over(_all())))

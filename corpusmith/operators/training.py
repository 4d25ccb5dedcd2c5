"""Arithmetic around training and evaluation: steps, learning rates, comparison of results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scaled_steps(spark: SparkSession, steps: int, full_bytes: int, subset_bytes: int) -> DataFrame:
    """The steps that give a subset as many passes as ``steps`` give the full set."""
    return spark.range(1).select(F.round(F.lit(float(steps)) / (F.lit(float(full_bytes)) / F.lit(float(subset_bytes)))).cast("long").alias("steps"))


def lr_schedule(spark: SparkSession, max_steps: int, rate: float, least: float, warmup: float = 0.01) -> DataFrame:
    """``step, lr``: linear warm-up, then half a cosine down to zero, never below ``least``."""
    warm = int(max_steps * warmup)
    s = F.col("step").cast("double")
    down = 0.5 * (1 + F.cos(F.lit(math.pi) * (s - warm) / max(1, max_steps - warm)))
    lr = F.when(s < warm, rate * s / max(1, warm)).otherwise(F.greatest(F.lit(rate) * down, F.lit(least)))
    return spark.range(max_steps + 1).select(F.col("id").alias("step")).select("step", F.round(lr, 12).alias("lr"))


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """Results (``task, metric, value, stderr``) of two models: difference in percent of the first, the 95 % interval
    of the difference, and whether it excludes 0. A task that only one has is left out."""
    left = a.select("task", "metric", F.col("value").alias("va"), F.col("stderr").alias("sa"))
    right = b.select("task", "metric", F.col("value").alias("vb"), F.col("stderr").alias("sb"))
    d, half = F.col("vb") - F.col("va"), 1.96 * F.sqrt(F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb"))
    return left.join(right, ["task", "metric"]).select(
        "task", "metric", F.round(F.try_divide(d, F.col("va")) * 100, 4).alias("percent"), F.round(d + half, 6).alias("ci_high"), F.round(d - half, 6).alias("ci_low"), ((d - half > 0) | (d + half < 0)).alias("significant")
    )

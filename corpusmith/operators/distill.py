"""Distillation: exclude clusters, derive quotas, draw, split, and fetch the texts last."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from ..sources.shared import written
from . import quotas, sampling

#: Chosen ids that are broadcast (some 40 bytes each in a hash table).
FEW = 3_000_000


@dataclass(frozen=True)
class Config:
    total: int
    excluded: tuple[int, ...] = ()
    policy: str = "density"  # equal, proportional, density, low_topup, inter
    split: str = "ratio"  # ratio, fixed, scaled
    sizes: tuple[int, int, int] = (1_000_000, 500, 10_000)
    omega: float = 0.5
    weights: tuple[float, float, float] = field(default=(0.33, 0.33, 0.33))
    seed: int = 42


def selection(assignments: DataFrame, stats: DataFrame, config: Config, diversity: DataFrame | None = None) -> DataFrame:
    """``idx, cluster`` of the chosen documents: narrow rows, no text."""
    cut = list(config.excluded)
    rows = assignments.select("idx", "cluster")
    if config.policy == "equal":
        q = quotas.equal(stats, config.total, cut)
    elif config.policy == "proportional":
        q = quotas.proportional(stats, config.total, cut)
    elif config.policy == "density":
        q = quotas.density(stats, config.total, cut, config.omega)
    elif config.policy == "inter":
        q = quotas.inter(stats, diversity, config.total, cut, config.weights)
    elif config.policy == "low_topup":
        q = quotas.low_topup(stats, config.total, cut, config.omega)
        base = sampling.stratified(rows, q, seed=config.seed)
        return base.unionByName(sampling.top_up(rows, base, q, seed=config.seed))
    else:
        raise ValueError(config.policy)
    return sampling.stratified(rows, q, seed=config.seed)


def divide(selected: DataFrame, config: Config) -> DataFrame:
    if config.split == "ratio":
        return sampling.split_ratio(selected, seed=config.seed)
    kind = {"fixed": sampling.split_fixed, "scaled": sampling.split_scaled}[config.split]
    return kind(selected, *config.sizes, seed=config.seed)


def with_texts(selected: DataFrame, docs: DataFrame) -> DataFrame:
    """``split, pile_idx, text``: the texts of the chosen ids, which are written once and counted. Up to ``FEW`` of them go to
    the tasks, so no text is shuffled; more are joined by a shuffle."""
    ids = written(selected.select("idx", "split"), "chosen")
    texts, n = docs.select("idx", "text"), ids.count()
    found = texts.join(F.broadcast(ids) if n <= FEW else ids.hint("merge"), "idx")
    return found.select("split", F.col("idx").alias("pile_idx"), "text")


def distill(docs: DataFrame, assignments: DataFrame, stats: DataFrame, config: Config, diversity: DataFrame | None = None) -> DataFrame:
    return with_texts(divide(selection(assignments, stats, config, diversity), config), docs)


def write_distilled(docs: DataFrame, assignments: DataFrame, stats: DataFrame, config: Config, path: str, diversity: DataFrame | None = None, rows: int = 100_000) -> DataFrame:
    """:func:`distill` as a folder for each split with files of at most ``rows`` rows; returns what was written."""
    tables.write_parquet(distill(docs, assignments, stats, config, diversity), path, rows, by="split")
    return docs.sparkSession.read.schema("pile_idx BIGINT, text STRING, split STRING").parquet(path)

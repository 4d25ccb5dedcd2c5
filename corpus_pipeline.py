"""The corpus pipeline: language ID, toxicity, near-duplicates, mixing, packing.

Each stage works on all that the one before kept. It is handed Parquet that was written and read again, so a lost
executor costs a stage's tasks, not the stages before it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmith.llm import language_id, mixing, near_dedup, packing, toxicity
from corpusmith.llm.common import DOC_COLS, saved
from corpusmith.llm.encoding import vocabulary


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told stay; those without letters or with no clear language go."""
    return language_id.in_known_language(docs.select(*DOC_COLS))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; labels come from the table beside ``documents``."""
    return toxicity.non_toxic(docs.select(*DOC_COLS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, 0.8) stays."""
    return near_dedup.deduplicated(docs.select(*DOC_COLS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or their parts, that the mix takes: a row for each document and pass over its source."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids."""
    path = vocabulary("word_bpe_49k.json")
    return packing.read_pieces(packing.pack_documents(docs, path), path)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Learned models and token ids cannot be expressed in SQL. Tests hold the learned stages against their models' plain versions and
#: near-duplicates, mixing and packing against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each reading what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

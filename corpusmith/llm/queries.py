"""The queries of the training-data operators on the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language_id, mixing, near_dedup, packing, quality, tiff, token_output, topk_search, toxicity, url_filter
from .encoding import vocabulary


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as bit-packed token ids, written and read back."""
    return token_output.read_index(token_output.write_tokens(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.taken(_documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 4096 ids."""
    path = vocabulary("word_bpe_49k.json")
    return packing.read_pieces(packing.pack_documents(_documents(spark, sf_dir), path), path)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text, learned from the rows that are not held out."""
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text, learned from the rows that are not held out."""
    docs = _documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, _labels(spark, sf_dir)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the rows that are not held out."""
    docs = _documents(spark, sf_dir)
    return language_id.predict(docs, language_id.fit(docs))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and the verdict of every page's url."""
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of three-word shingles at 85 percent."""
    return near_dedup.near_duplicates(_documents(spark, sf_dir), shingle=3, threshold=0.85)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a TIFF and read back: lengths and digests of the payload and of the file."""
    return tiff.media_features(tiff.store_texts(_documents(spark, sf_dir)))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 50."""
    docs = _documents(spark, sf_dir)
    return topk_search.search(docs, docs.filter("doc_id % 50 = 0"))


_ALL = (op1_token_output, op2_mixing, op3_packing, op4_toxicity, op5_quality, op6_language_id, op7_url_filters, op8_minhash_near_dedup, op9_media_columns, op10_topk_search)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Only what DuckDB can express; tests hold the others against brute force."""
    return {"op7_url_filters": url_filter.oracle(), "op10_topk_search": topk_search.oracle()}

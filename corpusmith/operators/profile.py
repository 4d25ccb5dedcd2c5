"""What a corpus looks like: lengths, words, bytes. One aggregation each, no text is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def length_range(docs: DataFrame, text: str = "text") -> DataFrame:
    """Least and greatest length in code points; null of an empty table."""
    return docs.agg(F.min(F.length(text)).cast("long").alias("min_length"), F.max(F.length(text)).cast("long").alias("max_length"))


def word_count_histogram(docs: DataFrame, bins: int = 50, width: int | None = None, text: str = "text") -> DataFrame:
    """Documents by number of words, in ``bins`` bins of equal width up to the largest count (or of ``width``)."""
    counts = docs.select(T.word_count(F.col(text)).alias("n")).filter("n is not null").groupBy("n").agg(F.count("*").alias("docs"))
    if width is None:
        top = counts.agg(F.max("n")).first()[0] or 1
        width = max(1, -(-(top + 1) // bins))
    return counts.groupBy(F.expr(f"n div {width}").alias("bin")).agg(F.sum("docs").alias("docs")).select("bin", (F.col("bin") * width).alias("from_words"), "docs")


def top_words(docs: DataFrame, n: int = 50, text: str = "text") -> DataFrame:
    """The most frequent lower-cased words, ties by the word."""
    found = docs.select(F.explode(T.words(F.lower(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "word").limit(n)


def dataset_bytes(docs: DataFrame, text: str = "text", fixed: int = 8) -> DataFrame:
    """Rows, bytes of UTF-8 and bytes with ``fixed`` more a row for its key."""
    sums = docs.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("text_bytes"))
    return sums.withColumn("total_bytes", F.col("text_bytes") + fixed * F.col("n_rows"))

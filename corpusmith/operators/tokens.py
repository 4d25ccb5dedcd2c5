"""Subword tokens for training: a cached table of ids cut to the model's length, and statistics of lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokenised(docs: DataFrame, vocabulary: str, length: int = 2048) -> DataFrame:
    """``idx, input_ids, n_tokens``: the first ``length`` ids of each text under a ``tokenizers`` vocabulary, and how many there are
    in all. A null text has no ids. Write it as Parquet to scan it again without the tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = [e.ids for e in tokenizer.encode_batch_fast([t or "" for t in part.column(1).to_pylist()], add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[:length] for x in ids], pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64())], ["idx", "input_ids", "n_tokens"])

    return docs.select(F.col("idx").cast("long"), "text").mapInArrow(run, "idx long, input_ids array<int>, n_tokens long")


def length_stats(tokens: DataFrame, length: int = 2048) -> DataFrame:
    """``documents, tokens, mean_length, min_length, max_length, cut``: one row; ``cut`` documents are longer than ``length``. Of no
    documents all but the counts are null."""
    n = F.col("n_tokens")
    return tokens.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum(n), F.lit(0)).alias("tokens"), F.round(F.avg(n), 6).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.coalesce(F.sum((n > length).cast("long")), F.lit(0)).alias("cut")
    )

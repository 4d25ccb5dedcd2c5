"""Embedding: a pluggable encoder over Arrow batches, and a stand-in that hashes words."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_query


def hashed(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder: each word adds one to a signed bucket of its checksum."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            h = np.array([zlib.crc32(w.encode()) for w in text.split()], np.int64)
            np.add.at(row, (h >> 1) % dim, np.where(h & 1, 1.0, -1.0))
        return out

    return encode


def embed(docs: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]] = hashed) -> DataFrame:
    """``idx, embedding``: the encoder's vectors at length one. ``make`` builds the encoder once in each worker; a null
    text has a null embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            m = encode([t or "" for t in texts])
            n = np.linalg.norm(m, axis=1, keepdims=True)
            m = (m / np.where(n > 0, n, 1)).astype(np.float32)
            rows = [None if t is None else v.tolist() for t, v in zip(texts, m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["idx", "embedding"])

    return docs.select("idx", as_query(F.col("text")).alias("text")).mapInArrow(run, "idx long, embedding array<float>")

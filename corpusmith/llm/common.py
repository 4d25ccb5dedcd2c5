"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of ``documents``, in order; pipeline stages but the last return exactly these.
DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]

#: White space that separates words: ASCII space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sliced(batches: Iterator, rows: int = 500, size: int = 8 << 20) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows and, down to single rows, ``size`` bytes; empty ones are left out.

    Spark bounds what it sends (10,000 rows or 64 MB); the working memory of an operator is bounded here, without
    a setting of the session. At the end Arrow hands back what it has freed: workers outlive a task, and the stages after
    it would pay for its peak.
    """
    import pyarrow as pa

    try:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                todo = [batch.slice(i, rows)]
                while todo:
                    part = todo.pop()
                    if part.nbytes > size and part.num_rows > 1:
                        half = part.num_rows // 2
                        todo += [part.slice(half), part.slice(0, half)]
                    else:
                        yield part
    finally:
        pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master (as in
    tests) gets a temporary one; a cluster has to name it, as its machines do not see each other's folders."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="corpusmith-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    This cuts the lineage with files that any executor can read, under Spark's commit protocol, so a lost
    executor costs only its unfinished tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmith/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def held_out(doc_id: Column | str, n: int, fold: int) -> Column:
    """Whether a document belongs to the fold that models never see; false for a null id."""
    return F.coalesce(remainder(doc_id, n) == fold, F.lit(False))


def by_key(batches: Iterator, key: str) -> Iterator:
    """Regroup Arrow batches that are sorted by ``key`` into one table for each run of equal keys."""
    import numpy as np
    import pyarrow as pa

    kept: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if kept and keys[a] != last:
                yield last, pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
            last = keys[a]
    if kept:
        yield last, pa.Table.from_batches(kept)

"""Loss of documents under a proxy model: a pluggable scorer, and a native stand-in (unigram cross-entropy)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

from ..sources.shared import written

#: Words that are broadcast at most.
DIGITS, OFTEN = 6, 100_000


def unigram_loss(docs: DataFrame, chars: int = 512) -> DataFrame:
    """``idx, loss``: mean negative log-probability of the words in a text's first ``chars`` code points, under the
    word frequencies of all those. A text without words has loss 0."""
    w = docs.select("idx", F.explode(T.words(F.lower(T.truncated(F.col("text"), chars)))).alias("word"))
    per = w.groupBy("idx", "word").agg(F.count("*").alias("n"))
    per = written(per, "words")
    freq = written(per.groupBy("word").agg(F.sum("n").alias("f")), "frequencies")
    total = freq.agg(F.sum("f")).first()[0] or 1
    cost = F.round(-F.ln(F.col("f") / F.lit(float(total))), 9)
    # At most OFTEN words can make up more than one in OFTEN of all: they are broadcast, and no other word is a hot key.
    often = F.broadcast(freq.filter(F.col("f") * OFTEN > total))
    rest = per.join(often.select("word"), "word", "left_anti").join(freq.filter(F.col("f") * OFTEN <= total), "word")
    both = per.join(often, "word").select("idx", "n", "f").unionByName(rest.select("idx", "n", "f"))
    scored = both.groupBy("idx").agg((F.sum(F.col("n") * cost) / F.sum("n")).alias("l"))
    return docs.select("idx").join(scored, "idx", "left").select("idx", F.round(F.coalesce("l", F.lit(0.0)), DIGITS).alias("loss"))


def scored_by(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[float]]], chars: int = 512) -> DataFrame:
    """``idx, loss`` of a model of the caller's: ``make`` builds it once in each worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            loss = model([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(loss, pa.float64())], ["idx", "loss"])

    return docs.select("idx", T.truncated(F.col("text"), chars).alias("text")).mapInArrow(run, "idx long, loss double")


def mean_loss(scored: DataFrame) -> DataFrame:
    """``cluster, mean_loss`` over ``idx, cluster, loss``."""
    return scored.groupBy("cluster").agg(F.round(F.avg("loss"), DIGITS).alias("mean_loss"))


def proxy_sample(assignments: DataFrame, most: int = 1000, seed: int = 42) -> DataFrame:
    """At most ``most`` documents of each cluster, by the order of samples: those that a proxy model scores."""
    from .sampling import stratified

    sizes = assignments.select("cluster").distinct().withColumn("actual", F.lit(most).cast("long"))
    return stratified(assignments, sizes, purpose="proxy", seed=seed)


def oversampled(quotas: DataFrame, factor: float = 1.5) -> DataFrame:
    """Quotas of a first draw from which the highest losses are kept."""
    return quotas.select("cluster", F.floor(F.col("quota") * factor).cast("long").alias("actual"))

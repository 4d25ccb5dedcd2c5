"""Mini-batch spherical k-means over a stream of vector files.

The model is global and small, so the state is a table of centroids and weights that ``foreachBatch`` replaces: one
folder per batch id, written under Spark's commit protocol. A replayed batch starts from the state before it and
writes the same folder again, so a restart changes nothing. Within a batch, sums per cluster are partial aggregates.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clusters import cluster_sums

STATE = "cluster INT, centroid ARRAY<DOUBLE>, weight DOUBLE"


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def seeds(vectors: DataFrame, k: int, seed: int = 42, sample: int = 10_000) -> np.ndarray:
    """k-means++ starts from a bounded sample, chosen by a hash of the index."""
    rows = vectors.filter("vector is not null").orderBy(F.md5(F.concat(F.lit(f"{seed}:seed:"), F.col("idx").cast("string")).cast("binary"))).limit(sample).select("vector").collect()
    if not rows:
        return np.zeros((0, 0))
    m = unit(np.array([r.vector for r in rows], float))
    rng = np.random.default_rng(seed)
    chosen = [m[0]]
    while len(chosen) < min(k, len(m)):
        d = np.clip(1 - (m @ np.array(chosen).T).max(1), 0, None)
        chosen.append(m[int(rng.choice(len(m), p=d / d.sum()))] if d.sum() > 0 else m[len(chosen)])
    return np.array(chosen)


def fit_batch(vectors: DataFrame, k: int, seed: int = 42, rounds: int = 20) -> DataFrame:
    """``cluster, centroid`` from Spark ML's k-means with cosine distance."""
    from pyspark.ml.clustering import KMeans

    data = vectors.filter("vector is not null").select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    found = KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(data).clusterCenters()
    return vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "cluster int, centroid array<double>")


class StreamingKMeans:
    """State under ``path``; :meth:`step` is the function of ``foreachBatch``."""

    def __init__(self, spark: SparkSession, path: str, k: int, seed: int = 42):
        self.spark, self.path, self.k, self.seed = spark, path.rstrip("/"), k, seed

    def _at(self, batch_id: int) -> DataFrame:
        """The state after a batch; that it is missing is an error, as starting anew would lose what was learned."""
        return self.spark.read.schema(STATE).parquet(f"{self.path}/batch={batch_id}")

    def step(self, batch: DataFrame, batch_id: int) -> None:
        vectors = batch.filter("vector is not null")
        if batch_id:
            before = self._at(batch_id - 1)
        else:
            first = seeds(vectors, self.k, self.seed)
            before = self.spark.createDataFrame([(i, c.tolist(), 0.0) for i, c in enumerate(first)], STATE)
        state = {r.cluster: (np.array(r.centroid), r.weight) for r in before.collect()}
        # Each Arrow batch gives its sums per cluster, so vectors are read once and none is shuffled.
        for r in cluster_sums(vectors, before.select("cluster", "centroid")).collect():
            c, w = state[r.cluster]
            state[r.cluster] = (unit((w * c + np.array(r.total))[None])[0], w + r.n)
        rows = [(i, c.tolist(), float(w)) for i, (c, w) in sorted(state.items())]
        self.spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Consume what has arrived, then stop; returns the last state. Batches are as large as the source makes them
        (:func:`vector_files`); a restart goes on behind the last batch that is finished."""
        query = stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.latest()

    def latest(self) -> DataFrame:
        state = self.spark.read.schema(STATE + ", batch INT").parquet(self.path)
        last = state.agg(F.max("batch")).first()[0]
        return state.filter(F.col("batch") == last).drop("batch")


def vector_files(spark: SparkSession, path: str, schema, files: int = 4) -> DataFrame:
    """Parquet files as they arrive, at most ``files`` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)

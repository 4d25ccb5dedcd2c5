"""What the queries share: the driver's tables in the engine's terms, and the same in SQL.

``idx`` is ``vec_id`` and ``doc_id``, ``cluster`` is ``label``, a cluster's centroid the mean of its vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, stats
from ..sources.shared import written

EXCLUDED = [3, 7]
K = 10


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._kept, self._centers = spark, sf_dir, None, None

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def docs(self) -> DataFrame:
        return self.raw("documents").withColumnRenamed("doc_id", "idx")

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("idx"), F.col("label").cast("int").alias("cluster"), F.col("embedding").alias("vector"))

    def centers(self) -> DataFrame:
        """Centroids of all vectors, written once: a model-sized table that is counted, collected and compared."""
        if self._centers is None:
            self._centers = written(clusters.centroids(self.vectors()), "centroids")
        return self._centers

    def assigned(self) -> DataFrame:
        """Assignments of all vectors."""
        return clusters.own_distance(self.vectors(), self.centers())

    def chosen_from(self) -> DataFrame:
        """Assignments of those vectors that have a document: what quotas and samples work on."""
        return self.assigned().join(self.docs().select("idx"), "idx", "left_semi")

    def kept(self) -> DataFrame:
        """:meth:`chosen_from`, written once for all that a query makes of it."""
        if self._kept is None:
            self._kept = written(self.chosen_from(), "assignments")
        return self._kept

    def stats(self) -> DataFrame:
        return stats.cluster_stats(self.kept())


BASE = """
v AS (SELECT vec_id AS idx, CAST(label AS INT) AS cluster, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
dims AS (SELECT unnest(range(1, (SELECT max(len(e)) FROM v) + 1)) AS p),
c0 AS (SELECT cluster, p, round(avg(e[p]), 9) AS x FROM v, dims GROUP BY cluster, p),
cent AS (SELECT cluster, list(x ORDER BY p) AS c FROM c0 GROUP BY cluster),
a_all AS (SELECT v.idx, v.cluster, round(1 - list_dot_product(v.e, cent.c), 6) AS distance FROM v JOIN cent USING (cluster)),
a AS (SELECT * FROM a_all WHERE idx IN (SELECT doc_id FROM documents)),
st AS (SELECT cluster, count(*) AS n, round(sum(distance), 6) AS s, round(round(sum(distance), 6) / count(*), 6) AS r FROM a GROUP BY cluster),
inc AS (SELECT *, sum(n) OVER () AS total_n FROM st WHERE cluster NOT IN (3, 7))
"""


def sql(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([BASE, *more]) + "\n" + body

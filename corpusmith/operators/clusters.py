"""Vectors and centroids: means, nearest centroid, distances between centroids, merging.

A centroid table is a model: ``cluster, centroid``, at most ``MAX_MODEL`` numbers, which is checked before it goes to
the executors. Vectors never shuffle for an assignment: a matrix product per Arrow batch finds the nearest centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a centroid table (256 MB of doubles).
MAX_MODEL = 1 << 25
DIGITS = 6


def centroids(vectors: DataFrame, unit: bool = False) -> DataFrame:
    """``cluster, centroid``: the mean of each cluster's vectors, by partial sums; ``unit``: at length one."""
    mean = Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>")))
    found = vectors.filter("vector is not null").groupBy("cluster").agg(vector_to_array(mean).alias("c"))
    out = found.select("cluster", F.transform("c", lambda x: F.round(x, 9)).alias("centroid"))
    if unit:
        from ..functions.vectors import l2_normalize

        out = out.select("cluster", l2_normalize(F.col("centroid")).alias("centroid"))
    return out


def own_distance(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """``idx, cluster, distance`` of each vector to the centroid of the cluster it already has. A null vector, or a cluster
    that is null or has no centroid, gives no row. Vectors stay where they are: the centroids come to the tasks."""
    ids, c = model(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, known = _matrix(batch.column(2))
            own = batch.column(1).fill_null(0).to_numpy()[known].astype(np.int64)
            ok = batch.column(1).is_valid().to_numpy(zero_copy_only=False)[known]
            at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
            ok &= ids[at] == own if len(ids) else False
            m, at, rows = m[ok], at[ok], known[ok]
            d = 1.0 - np.einsum("ij,ij->i", m, c[at]) if len(rows) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(d)], ["idx", "cluster", "distance"])

    rows = vectors.select(F.col("idx").cast("long"), F.col("cluster").cast("int"), F.col("vector").cast("array<double>"))
    found = rows.mapInArrow(run, "idx long, cluster int, distance double")
    return found.select("idx", "cluster", F.round("distance", DIGITS).alias("distance"))


def model(centers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The centroid table on the driver, in order of clusters."""
    known = centers.filter("cluster is not null").select("cluster", "centroid")
    if known.agg(F.coalesce(F.sum(F.size("centroid").cast("long")), F.lit(0))).first()[0] > MAX_MODEL:
        raise ValueError(f"more than {MAX_MODEL} numbers in the centroid table")
    rows = sorted(known.collect())
    c = np.array([r.centroid for r in rows], float)
    return np.array([r.cluster for r in rows], np.int64), c.reshape(len(rows), -1) if rows else np.empty((0, 0))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that are not null, and where they are."""
    known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    kept = column.take(pa.array(known))
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(known), -1) if len(known) else np.empty((0, 0)), known


def assign(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """``idx, cluster, distance``: the nearest centroid and one less the dot product with it; ties to the lowest
    cluster. A null vector has neither. Distances are rounded before they are compared, so ties are ties."""
    ids, c = model(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, known = _matrix(batch.column(1))
            label, near = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            missing = np.ones(batch.num_rows, bool)
            if len(known) and len(ids):
                d = np.round(1.0 - m @ c.T, DIGITS)
                best = d.argmin(1)
                label[known], near[known], missing[known] = ids[best], d[np.arange(len(known)), best], False
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, mask=missing), pa.array(near, mask=missing)], ["idx", "cluster", "distance"])

    return vectors.select(F.col("idx").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(run, "idx long, cluster int, distance double")


def cluster_sums(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """``cluster, n, total``: number and sum (at length one) of the vectors nearest to each centroid; null vectors are left out."""
    ids, c = model(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, _ = _matrix(batch.column(0))
            if not len(m) or not len(ids):
                continue
            size = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(size > 0, size, 1)
            best = np.round(1.0 - m @ c.T, DIGITS).argmin(1)
            for k in np.unique(best):
                own = m[best == k]
                yield pa.RecordBatch.from_arrays([pa.array([ids[k]], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([own.sum(0).tolist()])], ["cluster", "n", "total"])

    parts = vectors.select(F.col("vector").cast("array<double>")).mapInArrow(run, "cluster int, n long, total array<double>")
    total = vector_to_array(Summarizer.sum(array_to_vector("total")))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), total.alias("total"))


def between(centers: DataFrame, nearest: bool = False) -> DataFrame:
    """For every centroid its mean cosine distance to all others (``cluster, diversity``), or with ``nearest`` the
    nearest other one (``cluster, neighbour, distance``). A single centroid has diversity 0 and no neighbour."""
    ids, c = model(centers)
    length = np.linalg.norm(c, axis=1) if len(c) else np.empty(0)
    unit = c / np.where(length > 0, length, 1)[:, None] if len(c) else c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, _ = _matrix(batch.column(1))
            own = batch.column(0).to_numpy().astype(np.int64)
            size = np.linalg.norm(m, axis=1)
            d = np.round(1.0 - (m / np.where(size > 0, size, 1)[:, None]) @ unit.T, DIGITS)
            me = own[:, None] == ids[None, :]
            if not nearest:
                mean = np.where(me, 0, d).sum(1) / max(1, len(ids) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.round(mean, DIGITS))], ["cluster", "diversity"])
            elif len(ids) > 1:
                d = np.where(me, np.inf, d)
                best = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(ids[best].astype(np.int32)), pa.array(d[np.arange(len(own)), best])], ["cluster", "neighbour", "distance"])

    schema = "cluster int, neighbour int, distance double" if nearest else "cluster int, diversity double"
    return centers.select(F.col("cluster").cast("int"), F.col("centroid").cast("array<double>")).mapInArrow(run, schema)


def merge_pairs(neighbours: DataFrame, below: float) -> DataFrame:
    """``cluster, merged``: clusters whose nearest neighbour is nearer than ``below`` join it, and what hangs
    together through such pairs gets its lowest cluster; the others keep their own. Works on a model-sized table."""
    near = neighbours.filter(F.col("distance") < below).select("cluster", "neighbour")
    if near.count() > MAX_MODEL // 8:
        raise ValueError("too many pairs for a model-sized table")
    pairs = near.collect()
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    table = neighbours.sparkSession.createDataFrame([(x, root(x)) for x in list(up)], "cluster int, m int")
    return neighbours.select("cluster").join(F.broadcast(table), "cluster", "left").select("cluster", F.coalesce("m", "cluster").alias("merged"))


def relabel(assignments: DataFrame, mapping: DataFrame, default: int | None = None) -> DataFrame:
    """Assignments under the new names of ``mapping`` (``cluster, merged``); without one, ``default`` or the old."""
    other = F.lit(default).cast("int") if default is not None else F.col("cluster")
    named = mapping.select("cluster", F.col("merged").alias("_cs_merged"))
    found = assignments.join(named, "cluster", "left").withColumn("cluster", F.coalesce("_cs_merged", other))
    return found.select(*[F.col(f"`{c}`") for c in assignments.columns])

"""The incremental fit: batches of files, late files, a restart in the middle, a lost state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmith.operators import clusters
from corpusmith.streaming.kmeans import StreamingKMeans, fit_batch, unit, vector_files

SCHEMA = "idx long, vector array<double>"


def files(spark, path, first, last):
    rng = np.random.default_rng(1)
    centers = unit(rng.normal(0, 1, (3, 8)))
    for f in range(12):
        m = unit(centers[rng.integers(0, 3, 40)] + rng.normal(0, 0.05, (40, 8)))
        if first <= f < last:
            spark.createDataFrame([(f * 40 + i, v.tolist()) for i, v in enumerate(m)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return centers


def state(model):
    return [(r.cluster, np.round(r.centroid, 9).tolist(), r.weight) for r in model.latest().orderBy("cluster").collect()]


def test_restarted_fit_equals_an_unbroken_one(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    centers = files(spark, path, 0, 5)
    schema = spark.createDataFrame([], SCHEMA).schema
    whole = StreamingKMeans(spark, f"file://{tmp_path}/whole", 3)
    whole.run(vector_files(spark, path, schema, 2), f"file://{tmp_path}/whole-log")
    # A run that fails in its third batch, after the state of the second; then a restart with the same log.
    broken = StreamingKMeans(spark, f"file://{tmp_path}/broken", 3)
    step = broken.step

    def failing(batch, n):
        if n == 2:
            raise RuntimeError("lost")
        step(batch, n)

    broken.step = failing
    with pytest.raises(Exception, match="lost"):
        broken.run(vector_files(spark, path, schema, 2), f"file://{tmp_path}/broken-log")
    again = StreamingKMeans(spark, f"file://{tmp_path}/broken", 3)
    again.run(vector_files(spark, path, schema, 2), f"file://{tmp_path}/broken-log")
    assert state(again) == state(whole)
    assert spark.read.parquet(f"file://{tmp_path}/whole").select("batch").distinct().count() == 3  # two files each, one left
    # Late files make further batches, and all vectors count.
    files(spark, path, 5, 8)
    again.run(vector_files(spark, path, schema, 2), f"file://{tmp_path}/broken-log")
    assert sum(w for _, _, w in state(again)) == 8 * 40
    found = np.array([c for _, c, _ in state(again)])
    assert (found @ centers.T).max(0).min() > 0.98  # each true centre is found
    # The files themselves decide; a plain repetition of the rules gives the same state.
    near = clusters.assign(spark.read.parquet(path), again.latest())
    assert near.agg(F.avg("distance")).first()[0] < 0.05


def test_one_batch_equals_a_plain_step(spark, tmp_path):
    files(spark, f"file://{tmp_path}/in", 0, 2)
    data = spark.read.parquet(f"file://{tmp_path}/in")
    model = StreamingKMeans(spark, f"file://{tmp_path}/s", 3)
    model.step(data, 0)
    from corpusmith.streaming.kmeans import seeds

    m = unit(np.array([r.vector for r in data.orderBy("idx").collect()]))
    c = seeds(data, 3)
    best = np.round(1 - m @ c.T, 6).argmin(1)
    for k, centroid, weight in state(model):
        assert weight == (best == k).sum() and centroid == pytest.approx(unit(m[best == k].sum(0)[None])[0].tolist(), abs=1e-8)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        model.step(data, 7)  # the state after batch 6 is missing: no silent new start
    model.step(data.limit(0), 1)
    assert [w for *_, w in state(model)] == [(best == k).sum() for k in range(3)]


def test_batch_fit_finds_the_centres(spark, tmp_path):
    centers = files(spark, f"file://{tmp_path}/in", 0, 3)
    found = np.array([r.centroid for r in fit_batch(spark.read.parquet(f"file://{tmp_path}/in"), 3).collect()])
    assert (unit(found) @ centers.T).max(0).min() > 0.98

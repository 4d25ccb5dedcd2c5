"""Queries by name. Each is a function of the driver's tables, registered with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import clusters, density, distill, embedding, losses, profile, quotas, sampling, shards, stats, training
from ..sources import tables
from ..sources.shared import shared_path, written
from .base import EXCLUDED, Tables, K, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Build = Callable[[Tables], DataFrame]


def query(oracle: str | None = None) -> Callable[[Build], Build]:
    """Registers a query under its function's name."""

    def add(f: Build) -> Build:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


# Scans, slices and filters


@query("SELECT doc_id AS idx, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000")
def scan_documents(t):
    """Filter and columns reach the Parquet scan."""
    return t.docs().filter("lang = 'en' and n_chars > 1000").select("idx", "source", "n_chars")


@query("SELECT 'labelled' AS split, count(*) AS n FROM labels UNION ALL SELECT 'corpus', count(*) FROM documents")
def scan_splits(t):
    both = tables.read_splits(t.spark, {"labelled": f"{t.dir}/labels.parquet", "corpus": f"{t.dir}/documents.parquet"}, ["doc_id"])
    return both.groupBy("split").agg(F.count("*").alias("n"))


@query(sql("SELECT idx, cluster, distance FROM a WHERE cluster NOT IN (3, 7)"))
def exclude_clusters(t):
    return quotas.included(t.chosen_from(), EXCLUDED, expected=2).select("idx", "cluster", "distance")


@query("SELECT vec_id AS idx FROM embeddings WHERE label = 4")
def cluster_members(t):
    return t.vectors().filter("cluster = 4").select("idx")


@query("SELECT doc_id AS idx, source FROM documents WHERE doc_id >= (SELECT count(*) FROM documents) // 2")
def resume_offset(t):
    done = t.docs().count() // 2
    return shards.resume_after(t.docs(), done).select("idx", "source")


@query("SELECT doc_id AS idx, source FROM documents WHERE doc_id >= 100 AND doc_id < 150")
def section_slice(t):
    return shards.section(t.docs(), 2, 3, 50).select("idx", "source")


@query("SELECT doc_id AS idx, substring(text, 1, 512) AS text, 'query: ' || substring(text, 1, 64) AS query FROM documents")
def truncate_text(t):
    return t.docs().select("idx", T.truncated(F.col("text"), 512).alias("text"), T.as_query(T.truncated(F.col("text"), 64)).alias("query"))


EXTREMES = """
ex AS (
  SELECT cluster, 'closest' AS side, rn AS rank, idx, distance FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, idx) AS rn FROM a) WHERE rn <= 5
  UNION ALL
  SELECT cluster, 'farthest', rn, idx, distance FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance DESC, idx) AS rn FROM a) WHERE rn <= 5
)"""


@query(sql("SELECT cluster, side, rank, idx, distance, substring(text, 1, 256) AS text FROM ex JOIN documents ON doc_id = idx", EXTREMES))
def cluster_extremes(t):
    return stats.extremes(t.chosen_from(), t.docs())


@query(sql("SELECT cluster, side, rank, CASE WHEN length(substring(text, 1, 256)) > 100 THEN substring(text, 1, 100) || '...' ELSE substring(text, 1, 256) END AS shown FROM ex JOIN documents ON doc_id = idx", EXTREMES))
def inspect_clusters(t):
    return stats.inspect(stats.extremes(t.chosen_from(), t.docs()), 100)


# Profile


@query("SELECT min(length(text)) AS min_length, max(length(text)) AS max_length FROM documents")
def text_length_minmax(t):
    return profile.length_range(t.docs())


WORDS = r"list_filter(string_split_regex({}, '[ \t\n\v\f\r]+'), lambda x: x <> '')"


@query(f"SELECT bin, bin * 100 AS from_words, count(*) AS docs FROM (SELECT len({WORDS.format('text')}) // 100 AS bin FROM documents) GROUP BY bin")
def word_count_hist(t):
    return profile.word_count_histogram(t.docs(), width=100)


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS.format('lower(text)')}) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 50")
def top_words(t):
    return profile.top_words(t.docs())


@query("SELECT count(*) AS n_rows, sum(strlen(text)) AS text_bytes, sum(strlen(text)) + 8 * count(*) AS total_bytes FROM documents")
def dataset_bytes(t):
    return profile.dataset_bytes(t.docs())


@query(sql("SELECT (count(*) + 99) // 100 AS total_chunks, 100 AS chunk_size, 'cluster_results' AS prefix, count(*) AS total_entries FROM a"))
def assignment_metadata(t):
    return stats.assignment_metadata(t.chosen_from(), 100)


# Vectors


@query("SELECT vec_id AS idx, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS length, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first_unit FROM embeddings")
def l2_normalize(t):
    v = F.col("vector")
    return t.vectors().select("idx", F.round(V.norm(v), 6).alias("length"), F.round(V.l2_normalize(v)[0], 6).alias("first_unit"))


@query(sql("SELECT * FROM a"))
def centroid_distance(t):
    return t.chosen_from().select("idx", "cluster", "distance")


@query(sql("SELECT idx, cluster, distance FROM (SELECT v.idx, cent.cluster, round(1 - list_dot_product(v.e, cent.c), 6) AS distance, row_number() OVER (PARTITION BY v.idx ORDER BY round(1 - list_dot_product(v.e, cent.c), 6), cent.cluster) AS rn FROM v, cent) WHERE rn = 1"))
def assign_clusters(t):
    return clusters.assign(t.vectors(), t.centers())


@query(sql("SELECT cluster, p - 1 AS dim, round(x, 6) AS x FROM c0"))
def cluster_centroids(t):
    return t.centers().select("cluster", F.posexplode("centroid").alias("dim", "x")).withColumn("x", F.round("x", 6)).withColumn("dim", F.col("dim").cast("long"))


NEAR = """
pr AS (SELECT a.cluster AS x, b.cluster AS y, round(list_cosine_distance(a.c, b.c), 6) AS d FROM cent a, cent b WHERE a.cluster <> b.cluster),
nn AS (SELECT x AS cluster, y AS neighbour, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY d, y) AS rn FROM pr) WHERE rn = 1),
div AS (SELECT x AS cluster, round(avg(d), 6) AS diversity FROM pr GROUP BY x)"""


@query(sql("SELECT * FROM div", NEAR))
def inter_diversity(t):
    return clusters.between(t.centers())


@query(sql("SELECT * FROM nn", NEAR))
def centroid_nn(t):
    return clusters.between(t.centers(), nearest=True)


MERGED = """
below AS (SELECT cluster AS x, neighbour AS y FROM nn WHERE distance < (SELECT median(distance) FROM nn)),
sym AS (SELECT x, y FROM below UNION SELECT y, x FROM below),
reach AS (SELECT x, x AS y FROM sym UNION SELECT reach.x, sym.y FROM reach JOIN sym ON reach.y = sym.x),
mp AS (SELECT cluster, coalesce((SELECT min(y) FROM reach WHERE x = cluster), cluster) AS merged FROM nn)"""


def _merged(t):
    near = clusters.between(t.centers(), nearest=True)
    return clusters.merge_pairs(near, near.agg(F.percentile("distance", F.lit(0.5))).first()[0])


@query(sql("SELECT * FROM mp", NEAR, MERGED).replace("WITH", "WITH RECURSIVE", 1))
def merge_pairs(t):
    return _merged(t)


@query(sql("SELECT idx, CAST(merged AS INT) AS cluster, distance FROM a JOIN mp USING (cluster)", NEAR, MERGED).replace("WITH", "WITH RECURSIVE", 1))
def relabel_clusters(t):
    return clusters.relabel(t.chosen_from(), _merged(t)).select("idx", "cluster", "distance")


@query()
def two_phase_clusters(t):
    """Density clusters of blocks of 2000 vectors with merged centroids; noise is -1."""
    return density.two_phase(t.vectors(), 2000, 20, 10)


@query(
    """WITH h AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT idx, round((e[1] + e[17] + e[49]) / 3, 6) AS m0, round((e[16] + e[32] + e[64]) / 3, 6) AS m15 FROM h"""
)
def mean_pool(t):
    """A vector as four token states of 16 numbers, the third of them masked."""
    states = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("vector", i * 16 + 1, 16))
    pooled = V.masked_mean(states, F.array(*map(F.lit, (1, 1, 0, 1))))
    return t.vectors().select("idx", pooled.alias("m")).select("idx", F.round(F.col("m")[0], 6).alias("m0"), F.round(F.col("m")[15], 6).alias("m15"))


@query()
def embed_stub(t):
    return embedding.embed(t.docs())


@query()
def kmeans_fit(t):
    from ..streaming.kmeans import fit_batch

    return fit_batch(t.vectors(), K)


@query()
def stream_fit(t):
    """The same vectors as a stream of files, with the state of each batch kept beside the checkpoint."""
    from ..streaming.kmeans import StreamingKMeans, vector_files

    at = shared_path(t.spark, "kmeans")
    stream = vector_files(t.spark, f"{t.dir}/embeddings.parquet*", t.raw("embeddings").schema)
    vectors = stream.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    return StreamingKMeans(t.spark, f"{at}/state", K).run(vectors, f"{at}/checkpoint")


# Statistics and masks


@query(sql(f"SELECT k.cluster, coalesce(n, 0) AS total_examples, coalesce(s, 0) AS sum_distance, coalesce(r, 0) AS average_distance FROM (SELECT CAST(unnest(range({K + 2})) AS INT) AS cluster) k LEFT JOIN st USING (cluster)"))
def cluster_stats(t):
    return stats.cluster_stats(t.chosen_from(), K + 2)


@query(sql("SELECT cluster, r AS density FROM st"))
def cluster_density(t):
    return t.stats().select("cluster", F.col("average_distance").alias("density"))


THRESHOLD = """
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, idx) AS rn FROM a),
th AS (SELECT cluster, max(distance) AS threshold FROM rk WHERE rn <= 13 GROUP BY cluster),
mask AS (SELECT idx, cluster, distance <= threshold AND cluster NOT IN (3, 7) AS keep FROM a JOIN th USING (cluster))"""


@query(sql("SELECT * FROM th", THRESHOLD))
def cluster_threshold(t):
    return stats.thresholds(t.kept(), 12)


@query(sql("SELECT * FROM mask", THRESHOLD))
def threshold_mask(t):
    return stats.threshold_mask(t.kept(), 12, EXCLUDED)


@query(sql("SELECT count(*) AS total_examples, count(*) FILTER (keep) AS kept_examples, round(100.0 * count(*) FILTER (keep) / count(*), 6) AS percentage_kept FROM mask", THRESHOLD))
def mask_metadata(t):
    return stats.mask_metadata(stats.threshold_mask(t.kept(), 12, EXCLUDED))


# Quotas

T_ALL = 700
EQUAL = "eq AS (SELECT cluster, n, {0} // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY cluster) <= {0} % (count(*) OVER ()) THEN 1 ELSE 0 END AS quota FROM inc)"
DENSITY = "de AS (SELECT cluster, n, CAST(greatest(floor({0} * (CAST(n AS DOUBLE) / total_n) * (1 - {1} * r)), 0) AS BIGINT) AS quota FROM inc)"
OUT = "SELECT cluster, quota, least(quota, n) AS actual FROM "


@query(sql(OUT + "eq", EQUAL.format(T_ALL)))
def quota_equal(t):
    return quotas.equal(t.stats(), T_ALL, EXCLUDED)


@query(sql(OUT + "eq", EQUAL.format(T_ALL + 13)))
def quota_equal_k440(t):
    """The same policy under another configuration's total."""
    return quotas.equal(t.stats(), T_ALL + 13, EXCLUDED)


@query(sql(OUT + "(SELECT cluster, n, CAST(floor(700 * (CAST(n AS DOUBLE) / total_n)) AS BIGINT) AS quota FROM inc)"))
def quota_proportional(t):
    return quotas.proportional(t.stats(), T_ALL, EXCLUDED)


@query(sql(OUT + "de", DENSITY.format(T_ALL, 0.5)))
def quota_density(t):
    return quotas.density(t.stats(), T_ALL, EXCLUDED, 0.5)


@query(sql(OUT + "de", DENSITY.format(T_ALL // 4, 0.5)))
def quota_density_tiny(t):
    return quotas.density(t.stats(), T_ALL // 4, EXCLUDED, 0.5)


@query(sql(OUT + "de", DENSITY.format(T_ALL, 0.25)))
def quota_density_high(t):
    return quotas.density(t.stats(), T_ALL, EXCLUDED, 0.25)


TOPUP = """
de AS (SELECT cluster, n, total_n, CAST(greatest(floor(200 * (CAST(n AS DOUBLE) / total_n) * (1 - 0.75 * r)), 0) AS BIGINT) AS quota FROM inc),
o AS (SELECT *, least(quota, n) AS actual, CAST(n AS DOUBLE) / total_n AS share, row_number() OVER (ORDER BY cluster) AS i FROM de),
fold AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(greatest(200 - (SELECT sum(actual) FROM o), 0) AS BIGINT) AS left_over, CAST(0 AS BIGINT) AS topup
  UNION ALL
  SELECT o.i, left_over - CASE WHEN left_over > 0 THEN least(CAST(floor(left_over * share) AS BIGINT), n - actual) ELSE 0 END, CASE WHEN left_over > 0 THEN least(CAST(floor(left_over * share) AS BIGINT), n - actual) ELSE 0 END
  FROM fold JOIN o ON o.i = fold.i + 1
),
lt AS (SELECT cluster, quota, actual, topup FROM o JOIN fold USING (i))"""
PICK = """
base AS (SELECT a.idx, a.cluster FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5('42:sample:' || idx), idx) AS rn FROM a) a JOIN lt USING (cluster) WHERE rn <= actual),
rest AS (SELECT * FROM a WHERE idx NOT IN (SELECT idx FROM base)),
tops AS (SELECT r.idx, r.cluster FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5('42:topup:' || idx), idx) AS rn FROM rest) r JOIN lt USING (cluster) WHERE rn <= topup)"""


def _recursive(body: str, *more: str) -> str:
    return sql(body, *more).replace("WITH", "WITH RECURSIVE", 1)


def _low(t):
    return quotas.low_topup(t.stats(), 200, EXCLUDED)


@query(_recursive("SELECT * FROM lt", TOPUP))
def quota_low_topup(t):
    return _low(t)


@query(_recursive("SELECT a.idx, a.cluster FROM a WHERE idx NOT IN (SELECT idx FROM base)", TOPUP, PICK))
def topup_anti(t):
    rows = t.kept().select("idx", "cluster")
    return shards.not_done(rows, sampling.stratified(rows, _low(t)))


@query(_recursive("SELECT * FROM base UNION ALL SELECT * FROM tops", TOPUP, PICK))
def topup_union(t):
    return distill.selection(t.kept(), t.stats(), distill.Config(200, tuple(EXCLUDED), "low_topup", omega=0.75))


INTER = """
sc AS (SELECT inc.cluster, n, round({0} * (CAST(n AS DOUBLE) / total_n) + {1} * (1 - r) + {2} * (diversity / max(diversity) OVER ()), 9) AS score FROM inc JOIN div USING (cluster)),
iq AS (SELECT cluster, n, CAST(floor(700 * (score / sum(score) OVER ())) AS BIGINT) AS quota FROM sc)"""


@query(sql(OUT + "iq", NEAR, INTER.format(0.33, 0.33, 0.33)))
def quota_inter(t):
    return quotas.inter(t.stats(), clusters.between(t.centers()), T_ALL, EXCLUDED)


@query(sql(OUT + "iq", NEAR, INTER.format(0.25, 0.25, 0.5)))
def quota_inter_high(t):
    return quotas.inter(t.stats(), clusters.between(t.centers()), T_ALL, EXCLUDED, (0.25, 0.25, 0.5))


# Loss

LOSS = f"""
w AS (SELECT doc_id AS idx, unnest({WORDS.format("lower(substring(text, 1, 512))")}) AS word FROM documents),
per AS (SELECT idx, word, count(*) AS n FROM w GROUP BY idx, word),
fr AS (SELECT word, sum(n) AS f FROM per GROUP BY word),
lo AS (SELECT idx, sum(n * round(-ln(f / CAST((SELECT sum(f) FROM fr) AS DOUBLE)), 9)) / sum(n) AS l FROM per JOIN fr USING (word) GROUP BY idx),
ls AS (SELECT doc_id AS idx, round(coalesce(l, 0), 6) AS loss FROM documents LEFT JOIN lo ON idx = doc_id),
sc AS (SELECT a.idx, a.cluster, loss FROM a JOIN ls USING (idx)),
ml AS (SELECT cluster, round(avg(loss), 6) AS mean_loss FROM sc GROUP BY cluster),
lp AS (SELECT cluster, mean_loss, round(mean_loss / sum(mean_loss) OVER () * 300, 6) AS proportion FROM ml WHERE cluster NOT IN (3, 7)),
lq AS (SELECT cluster, CAST(round_even(proportion, 0) AS BIGINT) AS quota, least(CAST(round_even(proportion, 0) AS BIGINT), n) AS actual FROM lp JOIN st USING (cluster))"""


def _scored(t):
    """Losses of the clustered documents, written once for proportions, quotas and the draw."""
    if not hasattr(t, "scored"):
        t.scored = written(losses.unigram_loss(t.docs()).join(t.kept().select("idx", "cluster"), "idx").select("idx", "cluster", "loss"), "losses")
    return t.scored


def _proportions(t):
    return quotas.loss_proportions(quotas.included(losses.mean_loss(_scored(t)), EXCLUDED), 300)


@query(sql("SELECT * FROM ls", LOSS))
def unigram_loss(t):
    return losses.unigram_loss(t.docs())


@query(sql("SELECT * FROM ml", LOSS))
def mean_loss(t):
    return losses.mean_loss(_scored(t))


@query(sql("SELECT * FROM lp", LOSS))
def loss_proportions(t):
    return _proportions(t)


@query(sql("SELECT * FROM lq", LOSS))
def loss_quota(t):
    return quotas.loss_quota(_proportions(t), t.stats())


OVER = "ov AS (SELECT sc.* FROM (SELECT sc.*, row_number() OVER (PARTITION BY cluster ORDER BY md5('42:sample:' || idx), idx) AS rn FROM sc) sc JOIN lq USING (cluster) WHERE rn <= CAST(floor(quota * 1.5) AS BIGINT))"


@query(sql("SELECT idx, cluster, loss FROM (SELECT idx, cluster, loss, row_number() OVER (PARTITION BY cluster ORDER BY loss DESC, idx) AS up FROM ov) JOIN lq USING (cluster) WHERE up <= actual", LOSS, OVER))
def loss_topn(t):
    """Draw half as many again as the quota, keep those of highest loss."""
    q = quotas.loss_quota(_proportions(t), t.stats())
    return sampling.top_by_loss(sampling.stratified(_scored(t), losses.oversampled(q)), q)


@query(
    sql(
        "SELECT idx, cluster, loss FROM (SELECT idx, cluster, loss, row_number() OVER (PARTITION BY cluster ORDER BY loss DESC, idx) AS up, row_number() OVER (PARTITION BY cluster ORDER BY loss, idx DESC) AS down FROM sc) JOIN lq USING (cluster) WHERE up <= floor(actual * CAST(0.8 AS DOUBLE)) OR down <= actual - floor(actual * CAST(0.8 AS DOUBLE))",
        LOSS,
    )
)
def loss_top_bottom(t):
    return sampling.top_by_loss(_scored(t), quotas.loss_quota(_proportions(t), t.stats()), bottom=0.2)


# Samples and splits

SAMPLE = (
    DENSITY.format(T_ALL, 0.5),
    "sel AS (SELECT a.idx, a.cluster FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5('42:sample:' || idx), idx) AS rn FROM a) a JOIN de USING (cluster) WHERE rn <= least(quota, n))",
    "pos AS (SELECT *, row_number() OVER (ORDER BY md5('42:split:' || idx), idx) AS r, count(*) OVER () AS m FROM sel)",
    "ratio AS (SELECT idx, cluster, CASE WHEN r <= floor(m * CAST(0.9896091 AS DOUBLE)) THEN 'train' WHEN r <= floor(m * CAST(0.9896091 AS DOUBLE)) + floor(m * CAST(0.009896091 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM pos)",
)
CONFIG = distill.Config(T_ALL, tuple(EXCLUDED))


def _selected(t):
    return distill.selection(t.kept(), t.stats(), CONFIG)


@query(sql("SELECT idx, cluster FROM sel", *SAMPLE))
def stratified_sample(t):
    return _selected(t)


@query(sql("SELECT doc_id AS idx, source FROM documents WHERE doc_id IN (SELECT idx FROM sel)", *SAMPLE))
def semi_join_sampled(t):
    return t.docs().select("idx", "source").join(_selected(t).select("idx"), "idx", "left_semi")


@query(sql("SELECT idx, cluster FROM sel WHERE cluster < 5 UNION SELECT idx, cluster FROM sel WHERE cluster >= 4", *SAMPLE))
def selection_union(t):
    s = _selected(t)
    return s.filter("cluster < 5").unionByName(s.filter("cluster >= 4")).distinct()


@query(sql("SELECT DISTINCT idx FROM sel ORDER BY idx", *SAMPLE))
def selection_sorted(t):
    return _selected(t).select("idx").distinct().orderBy("idx")


@query(sql("SELECT min(idx) AS min_idx, max(idx) AS max_idx, count(*) AS n FROM sel", *SAMPLE))
def selection_summary(t):
    return _selected(t).agg(F.min("idx").alias("min_idx"), F.max("idx").alias("max_idx"), F.count("*").alias("n"))


@query(sql("SELECT idx, cluster, CASE WHEN r <= 60 THEN 'train' WHEN r <= 65 THEN 'validation' ELSE 'test' END AS split FROM pos WHERE r <= 80", *SAMPLE))
def split_fixed(t):
    return sampling.split_fixed(_selected(t), 60, 5, 15)


@query(sql("SELECT * FROM ratio", *SAMPLE))
def split_ratio(t):
    return sampling.split_ratio(_selected(t))


@query(sql("SELECT idx, cluster, CASE WHEN r <= floor(600 * (m / CAST(700 AS DOUBLE))) THEN 'train' WHEN r <= floor(600 * (m / CAST(700 AS DOUBLE))) + floor(20 * (m / CAST(700 AS DOUBLE))) THEN 'validation' ELSE 'test' END AS split FROM pos", *SAMPLE))
def split_scaled(t):
    return sampling.split_scaled(_selected(t), 600, 20, 80)


@query(sql("SELECT split, count(*) AS n FROM ratio GROUP BY split", *SAMPLE))
def split_counts(t):
    return sampling.split_ratio(_selected(t)).groupBy("split").agg(F.count("*").alias("n"))


@query(sql("SELECT idx, text FROM sel JOIN documents ON doc_id = idx", *SAMPLE))
def extract_text(t):
    return t.docs().select("idx", "text").join(_selected(t).select("idx"), "idx")


@query(sql("SELECT split, idx AS pile_idx, text FROM ratio JOIN documents ON doc_id = idx", *SAMPLE))
def distill_density(t):
    """The flagship: statistics, density quota, sample, ratio split, texts last."""
    return distill.distill(t.docs(), t.kept(), t.stats(), CONFIG)


@query(sql("SELECT CASE WHEN r <= 300 THEN 'train' WHEN r <= 310 THEN 'validation' ELSE 'test' END AS split, idx AS pile_idx, text FROM (SELECT *, row_number() OVER (ORDER BY md5('42:split:' || idx), idx) AS r FROM (SELECT a.idx FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5('42:sample:' || idx), idx) AS rn FROM a) a JOIN eq USING (cluster) WHERE rn <= least(quota, n))) JOIN documents ON doc_id = idx WHERE r <= 330", EQUAL.format(400)))
def distill_equal(t):
    return distill.distill(t.docs(), t.kept(), t.stats(), distill.Config(400, tuple(EXCLUDED), "equal", "fixed", (300, 10, 20)))


@query(sql("SELECT split, idx AS pile_idx, text FROM ratio JOIN documents ON doc_id = idx", *SAMPLE))
def distill_written(t):
    """The flagship with its sink: a folder for each split, read back."""
    return distill.write_distilled(t.docs(), t.kept(), t.stats(), CONFIG, shared_path(t.spark, "distilled")).select("split", "pile_idx", "text")


def _scaled(total: int, *sizes: int) -> str:
    """SQL of a density distillation of ``total`` documents in splits that are scaled to what there is."""
    n = sum(sizes)
    cut = [f"floor({x} * (m / CAST({n} AS DOUBLE)))" for x in sizes]
    return sql(
        f"SELECT CASE WHEN r <= {cut[0]} THEN 'train' WHEN r <= {cut[0]} + {cut[1]} THEN 'validation' ELSE 'test' END AS split, idx AS pile_idx, text FROM pos JOIN documents ON doc_id = idx",
        DENSITY.format(total, 0.5), *SAMPLE[1:3],
    )


NANO, PICO = (240, 10, 50), (120, 5, 25)


@query(_scaled(sum(NANO), *NANO))
def distill_nano(t):
    """A small configuration of the density policy: splits scaled to the number of rows."""
    return distill.distill(t.docs(), t.kept(), t.stats(), distill.Config(sum(NANO), tuple(EXCLUDED), "density", "scaled", NANO))


@query(_scaled(sum(PICO), *PICO))
def distill_pico(t):
    return distill.distill(t.docs(), t.kept(), t.stats(), distill.Config(sum(PICO), tuple(EXCLUDED), "density", "scaled", PICO))


K440 = "k AS (SELECT CAST(doc_id % 440 AS INT) AS cluster, count(*) AS n, round(avg(n_chars % 100) / 100, 6) AS r FROM documents WHERE doc_id % 440 >= 70 GROUP BY 1)"


def _k440(t):
    """Statistics of 440 clusters, of which the first 70 are excluded."""
    cluster = F.expr("cast(idx % 440 as int)").alias("cluster")
    return t.docs().groupBy(cluster).agg(F.count("*").alias("total_examples"), F.round(F.avg(F.expr("n_chars % 100")) / 100, 6).alias("average_distance"))


@query(f"WITH {K440} SELECT cluster, quota, least(quota, n) AS actual FROM (SELECT *, 1013163 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY cluster) <= 1013163 % count(*) OVER () THEN 1 ELSE 0 END AS quota FROM k)")
def quota_k440_equal(t):
    """440 clusters, 70 excluded, the configuration's whole total."""
    return quotas.check_total(quotas.equal(_k440(t), 1_013_163, list(range(70))), 1_013_163)


@query(f"WITH {K440} SELECT cluster, quota, least(quota, n) AS actual FROM (SELECT *, CAST(floor(1013163 * (CAST(n AS DOUBLE) / sum(n) OVER ()) * (1 - 0.5 * r)) AS BIGINT) AS quota FROM k)")
def quota_k440_density(t):
    return quotas.density(_k440(t), 1_013_163, list(range(70)))


@query(sql("SELECT cluster, round(avg(loss), 6) AS mean_loss FROM (SELECT sc.*, row_number() OVER (PARTITION BY cluster ORDER BY md5('42:proxy:' || idx), idx) AS rn FROM sc) WHERE rn <= 20 GROUP BY cluster", LOSS))
def proxy_loss(t):
    """Mean loss of at most so many documents of each cluster."""
    return losses.mean_loss(losses.proxy_sample(_scored(t), 20))


@query(sql("SELECT * FROM lp", LOSS))
def loss_lines(t):
    """Proportions written as JSON lines under the published names and read back."""
    at = shared_path(t.spark, "loss")
    tables.write_cluster_loss(_proportions(t), at)
    return tables.read_cluster_loss(t.spark, at)


@query(sql("""SELECT st.cluster, n AS total_examples, s AS sum_distance, r AS average_distance, (SELECT string_agg(substring(text, 1, 256), '|' ORDER BY distance, idx) FROM (SELECT a.*, text, row_number() OVER (PARTITION BY cluster ORDER BY distance, idx) AS rn FROM a JOIN documents ON doc_id = idx) x WHERE rn <= 5 AND x.cluster = st.cluster) AS near FROM st"""))
def cluster_info(t):
    """Cluster information in its published form, written and read back."""
    at = shared_path(t.spark, "info")
    tables.write_cluster_info(tables.cluster_info(t.stats(), stats.extremes(t.kept(), t.docs())), at)
    return tables.read_cluster_info(t.spark, at).select("cluster", "total_examples", "sum_distance", "average_distance", F.array_join("closest.text", "|").alias("near"))


@query(sql("SELECT cluster, c AS centroid FROM cent"))
def centroid_table(t):
    """Centroids written and read back."""
    at = shared_path(t.spark, "centroids")
    tables.write_centroids(t.centers(), at)
    return tables.read_centroids(t.spark, at)


@query("SELECT CAST((n + 99) // 100 AS BIGINT) AS total_chunks, CAST(100 AS BIGINT) AS chunk_size, 'cluster_results' AS prefix, n AS total_entries FROM (SELECT count(*) AS n FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))")
def chunk_metadata(t):
    """What the written chunks hold."""
    return tables.write_chunks(t.chosen_from().coalesce(1), shared_path(t.spark, "chunks"), 100)


@query("SELECT doc_id AS idx, source FROM documents WHERE doc_id >= 64 AND doc_id < 256")
def sections_written(t):
    """Two sections written by themselves, the second of them twice, and read back."""
    at, rows = shared_path(t.spark, "sections"), t.docs().select("idx", "source")
    for first, last in ((1, 2), (2, 4), (2, 4)):
        tables.write_section(shards.section(rows, first, last, 64), at, first, last, 64)
    return tables.read_sections(t.spark, at, rows.schema)


@query()
def token_lengths(t):
    """Statistics of tokenised lengths over a cached table of ids."""
    import public_tokenizers

    from ..operators import tokens

    return tokens.length_stats(written(tokens.tokenised(t.docs(), public_tokenizers.path("byte_bpe_50k.json")), "tokens"))


# Shards and positions


@query("SELECT doc_id AS idx, row_number() OVER (ORDER BY source, doc_id) - 1 AS ordinal FROM documents")
def assign_ordinal(t):
    return shards.with_ordinal(t.docs().select("idx", "source"), "source", "idx").select("idx", "ordinal")


SHARDS = "sh AS (SELECT shard, n, coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT doc_id // 64 AS shard, count(*) AS n FROM documents GROUP BY 1))"


@query(f"WITH {SHARDS} SELECT shard, n, CAST(start AS BIGINT) AS start FROM sh")
def shard_offsets(t):
    return shards.offsets(shards.shard_sizes(t.docs(), 64))


@query(f"WITH {SHARDS} SELECT d.doc_id AS idx, sh.shard, d.doc_id - CAST(sh.start AS BIGINT) AS local FROM documents d ASOF JOIN sh ON d.doc_id >= sh.start")
def shard_locate(t):
    return shards.locate(t.docs().select("idx"), shards.offsets(shards.shard_sizes(t.docs(), 64)))


@query(sql("SELECT idx // 64 AS shard, count(*) AS n FROM sel GROUP BY 1", *SAMPLE))
def shard_histogram(t):
    return shards.shard_sizes(_selected(t), 64)


@query(sql("SELECT cluster, count(*) AS n FROM a GROUP BY cluster"))
def cluster_partition_counts(t):
    """Assignments written to a folder for each cluster and read back from the folders."""
    at = shared_path(t.spark, "clusters")
    tables.write_jsonl(t.chosen_from().repartition("cluster"), at, by="cluster")
    return t.spark.read.schema(tables.ASSIGNMENT).json(at).groupBy("cluster").agg(F.count("*").alias("n"))


@query(sql("SELECT idx, cluster, distance FROM a"))
def jsonl_roundtrip(t):
    at = shared_path(t.spark, "lines")
    tables.write_jsonl(t.chosen_from().select("idx", "cluster", "distance"), at)
    return tables.read_jsonl(t.spark, at, tables.ASSIGNMENT)[0]


# Training and evaluation


@query("SELECT CAST(round(143000 / (CAST(824546807506 AS DOUBLE) / 5906108510)) AS BIGINT) AS steps")
def scaled_steps(t):
    return training.scaled_steps(t.spark, 143000, 824546807506, 5906108510)


@query(
    f"""SELECT step, round(CASE WHEN step < 10 THEN 0.0006 * CAST(step AS DOUBLE) / 10 ELSE greatest(CAST(0.0006 AS DOUBLE) * (0.5 * (1 + cos({math.pi!r} * (step - 10) / 1014))), 0.00006) END, 12) AS lr
    FROM (SELECT unnest(range(1025)) AS step)"""
)
def lr_schedule(t):
    return training.lr_schedule(t.spark, 1024, 0.0006, 0.00006)


@query(
    """SELECT task, metric, round(CAST(vb - va AS DOUBLE) / va * 100, 4) AS percent, round(vb - va + 1.96 * sqrt(sa * sa + sb * sb), 6) AS ci_high,
    round(vb - va - 1.96 * sqrt(sa * sa + sb * sb), 6) AS ci_low, (vb - va - 1.96 * sqrt(sa * sa + sb * sb) > 0 OR vb - va + 1.96 * sqrt(sa * sa + sb * sb) < 0) AS significant
    FROM (SELECT task, metric, CAST(va AS DOUBLE) AS va, CAST(sa AS DOUBLE) AS sa, CAST(vb AS DOUBLE) AS vb, CAST(sb AS DOUBLE) AS sb
      FROM (VALUES ('arc_challenge', 'acc', 0.1997, 0.0117, 0.2125, 0.0120), ('mmlu', 'acc', 0.2299, 0.0035, 0.2465, 0.0036), ('hellaswag', 'acc', 0.2903, 0.0045, 0.2582, 0.0044)) x(task, metric, va, sa, vb, sb))"""
)
def compare_models(t):
    """Published results of two models."""
    schema = "task string, metric string, value double, stderr double"
    a = t.spark.createDataFrame([("arc_challenge", "acc", 0.1997, 0.0117), ("mmlu", "acc", 0.2299, 0.0035), ("hellaswag", "acc", 0.2903, 0.0045)], schema)
    b = t.spark.createDataFrame([("arc_challenge", "acc", 0.2125, 0.0120), ("mmlu", "acc", 0.2465, 0.0036), ("hellaswag", "acc", 0.2582, 0.0044)], schema)
    return training.compare_models(a, b)

"""Operators on small hand-made inputs: published facts, edge cases, clashing names, nulls, empty tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from corpusmith.functions import text as T
from corpusmith.operators import clusters, distill, embedding, losses, profile, quotas, sampling, shards, stats, tokens, training
from corpusmith.sources import tables
from corpusmith.sources.shared import shared_path, written

ASSIGNED = "idx long, cluster int, distance double"
STATS = "cluster int, total_examples long, sum_distance double, average_distance double"


@pytest.fixture
def at(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def stat_table(spark, sizes, average=0.2):
    return spark.createDataFrame([(c, n, average * n, average) for c, n in sizes.items()], STATS)


# Published facts


def test_equal_quotas_of_182_and_370_clusters(spark):
    for k, total, each, extra in ((182, 1_010_500, 5552, 36), (370, 1_013_163, 2738, 103)):
        q = rows(quotas.equal(stat_table(spark, dict.fromkeys(range(k), 10_000)), total, []), "cluster")
        assert [x for _, x, _ in q] == [each + 1] * extra + [each] * (k - extra)
        quotas.check_total(quotas.equal(stat_table(spark, dict.fromkeys(range(k), 10_000)), total, []), total)


def test_ratio_splits():
    for n, want in ((946_465, (936_630, 9_366, 469)), (1_010_409, (999_909, 9_999, 501))):
        a, b = int(n * sampling.TRAIN), int(n * sampling.VALIDATION)
        assert (a, b, n - a - b) == want


def test_scaled_steps_and_comparison(spark):
    assert training.scaled_steps(spark, 143000, 824546807506, 5906108510).first().steps == 1024
    schema = "task string, metric string, value double, stderr double"
    r = training.compare_models(spark.createDataFrame([("arc", "acc", 0.1997, 0.0117)], schema), spark.createDataFrame([("arc", "acc", 0.2125, 0.0120)], schema)).first()
    assert math.isclose(r.percent, 6.4096, abs_tol=1e-4) and round(r.ci_high, 4) == 0.0456 and round(r.ci_low, 4) == -0.02 and not r.significant


def test_shard_offsets_of_mixed_sizes(spark):
    last = 134_318_121 - 52 * 1_048_576 - 152 * 524_288
    assert last == 100_393
    o = shards.mixed_offsets(spark, (52, 1_048_576), (152, 524_288), last)
    assert o.agg(F.max("start"), F.sum("n")).first()[:] == (134_318_121 - last, 134_318_121)
    found = rows(shards.locate(spark.createDataFrame([(0,), (1_048_575,), (1_048_576,), (134_318_120,), (None,)], "idx long"), o), "idx")
    assert found == [(None, None, None), (0, 0, 0), (1_048_575, 0, 1_048_575), (1_048_576, 1, 0), (134_318_120, 204, last - 1)]


def test_proportions_deal_the_total_and_round_half_to_even(spark):
    p = quotas.loss_proportions(spark.createDataFrame([(1, 1.0), (2, 3.0)], "cluster int, mean_loss double"), 100)
    assert rows(p, "cluster") == [(1, 1.0, 25.0), (2, 3.0, 75.0)]
    half = spark.createDataFrame([(1, 1.0, 2.5), (2, 1.0, 3.5), (3, 1.0, 9.0)], "cluster int, mean_loss double, proportion double")
    assert rows(quotas.loss_quota(half, stat_table(spark, {1: 9, 2: 9, 3: 4})), "cluster") == [(1, 2, 2), (2, 4, 4), (3, 9, 4)]


# Edge cases


def test_empty_cluster_has_a_row(spark):
    a = spark.createDataFrame([(1, 0, 0.5), (2, 2, 0.25), (3, 2, 0.75)], ASSIGNED)
    assert rows(stats.cluster_stats(a, 3), "cluster") == [(0, 1, 0.5, 0.5), (1, 0, 0.0, 0.0), (2, 2, 1.0, 0.5)]
    assert rows(stats.cluster_stats(a.limit(0), 1)) == [(0, 0, 0.0, 0.0)] and stats.cluster_stats(a.limit(0)).count() == 0


def test_quota_above_a_cluster_is_not_made_up_elsewhere(spark):
    a = spark.createDataFrame([(i, i % 2, 0.1) for i in range(3)] + [(i, 1, 0.1) for i in range(3, 20)], ASSIGNED)
    q = quotas.equal(stats.cluster_stats(a), 10, [])
    chosen = sampling.stratified(a, q)
    assert rows(chosen.groupBy("cluster").count(), "cluster") == [(0, 2), (1, 5)]
    assert chosen.columns == a.columns and quotas.check_selection(chosen, q) is chosen


def test_ties_go_to_the_lowest_index(spark):
    a = spark.createDataFrame([(i, 0, 0.5) for i in (9, 4, 7, 1, 3, 8, 2)], ASSIGNED)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "idx long, text string")
    found = rows(stats.extremes(a, docs, 3).filter("side = 'closest'").select("rank", "idx"), "rank")
    assert found == [(1, 1), (2, 2), (3, 3)]


def test_threshold_keeps_one_more_and_ties(spark):
    for distances, kept in (([0.1, 0.2, 0.3, 0.4, 0.5], 3), ([0.1, 0.2, 0.3, 0.3, 0.5], 4)):
        a = spark.createDataFrame([(i, 0, d) for i, d in enumerate(distances)], ASSIGNED)
        assert stats.threshold_mask(a, 2, []).filter("keep").count() == kept
        assert stats.threshold_mask(a, 2, [0]).filter("keep").count() == 0
    few = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.9)], ASSIGNED)
    assert rows(stats.thresholds(few, 5)) == [(0, 0.9)]
    assert rows(stats.mask_metadata(stats.threshold_mask(few.limit(0), 2, [])))[0] == (0, 0, 0.0)


def test_wrong_number_of_exclusions(spark):
    s = stat_table(spark, {1: 5, 2: 5})
    with pytest.raises(ValueError, match="38 clusters should be excluded, 37 are"):
        quotas.included(s, list(range(37)), expected=38)
    assert quotas.included(s, [2, 2], expected=1).count() == 1


def test_invariants_are_checked(spark):
    q = spark.createDataFrame([(1, 2, 2), (2, 1, 1)], "cluster int, quota long, actual long")
    good = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "idx long, cluster int")
    assert quotas.check_selection(good, q).count() == 3 and quotas.check_total(q, 3).count() == 2
    for bad in ([(1, 1), (1, 1), (3, 2)], [(1, 1), (2, 1)], [(-1, 1), (2, 1), (3, 2)], [(None, 1), (2, 1), (3, 2)], [(1, 1), (2, 1), (3, 2), (4, 5)]):
        with pytest.raises(ValueError):
            quotas.check_selection(spark.createDataFrame(bad, "idx long, cluster int"), q)
    with pytest.raises(ValueError, match="add up to 3"):
        quotas.check_total(q, 4)
    assert rows(quotas.not_noise(spark.createDataFrame([(1, -1), (2, 0), (3, None)], "idx long, cluster int"))) == [(2, 0)]


def test_top_up_in_order(spark):
    """30 are missing and every cluster has rows left: 9, 6, 5 are given in turn."""
    s = spark.createDataFrame([(1, 50, 50.0, 1.0), (2, 46, 46.0, 1.0), (3, 59, 59.0, 1.0)], STATS)
    q = quotas.low_topup(s, 30, [], omega=1.0)
    assert [r.topup for r in q.orderBy("cluster").collect()] == [9, 6, 5]


def test_quotas_are_rounded_down_and_never_below_zero(spark):
    s = spark.createDataFrame([(1, 27, 0.0, 0.0), (2, 73, 146.0, 2.0)], STATS)
    assert rows(quotas.proportional(s, 10, []), "cluster") == [(1, 2, 2), (2, 7, 7)]
    assert rows(quotas.density(s, 10, [], 1.0), "cluster") == [(1, 2, 2), (2, 0, 0)]
    assert quotas.density(s.limit(0), 10, []).count() == 0


def test_splits_place_every_row_once(spark):
    sel = spark.createDataFrame([(i, 0) for i in range(100)], "idx long, cluster int")
    fixed = sampling.split_fixed(sel, 60, 5, 15)
    assert rows(fixed.groupBy("split").count(), "split") == [("test", 15), ("train", 60), ("validation", 5)]
    assert fixed.select("idx").distinct().count() == 80 and fixed.columns == ["idx", "cluster", "split"]
    assert sampling.split_ratio(sel.limit(0)).count() == 0
    same = [rows(sampling.split_scaled(sel.repartition(n), 6, 2, 2), "idx") for n in (1, 7)]
    assert same[0] == same[1]


def test_top_and_bottom_losses_count_no_row_twice(spark):
    scored = spark.createDataFrame([(i, 0, float(i)) for i in range(10)] + [(20, 1, 1.0)], "idx long, cluster int, loss double")
    q = spark.createDataFrame([(0, 5, 5), (1, 3, 3)], "cluster int, quota long, actual long")
    assert rows(sampling.top_by_loss(scored, q).select("idx"), "idx") == [(5,), (6,), (7,), (8,), (9,), (20,)]
    assert rows(sampling.top_by_loss(scored, q, bottom=0.2).select("idx"), "idx") == [(0,), (6,), (7,), (8,), (9,), (20,)]
    assert losses.proxy_sample(scored, 4).count() == 5


def test_text_is_cut_by_code_points(spark):
    df = spark.createDataFrame([("ü😀" * 200,), (None,), ("ab",)], "text string")
    out = rows(df.select(F.length(T.truncated(F.col("text"), 256)), T.shortened(F.col("text"), 2)))
    assert out == [(256, "ü😀..."), (None, None), (2, "ab")]


def test_file_names_and_their_numbers(spark):
    df = spark.createDataFrame([(7,), (123_456_789,)], "n long")
    assert [r[0] for r in df.select(T.numbered("shard_", F.col("n"), 9)).collect()] == ["shard_000000007", "shard_123456789"]
    names = spark.createDataFrame([("shard_000000007.parquet",), ("a12b",), ("x_5",)], "s string")
    assert [r[0] for r in names.select(T.number_of(F.col("s"))).collect()] == [7, None, 5]


def test_histogram_of_fifty_bins(spark):
    df = spark.createDataFrame([("w " * i,) for i in range(1, 101)], "text string")
    found = rows(profile.word_count_histogram(df, 50), "bin")
    assert len(found) <= 51 and found[:2] == [(0, 0, 2), (1, 3, 3)] if found[1][1] == 3 else found[:2] == [(0, 0, 1), (1, 2, 2)]
    assert sum(n for *_, n in found) == 100


# Vectors


def test_own_distance_and_assignment(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 5, [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, 0, None)], "idx long, cluster int, vector array<double>")
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], "cluster int, centroid array<double>")
    assert rows(clusters.own_distance(v, c), "idx") == [(1, 0, 0.0), (2, 1, 0.2)]
    assert rows(clusters.assign(v, c), "idx") == [(1, 0, 0.0), (2, 1, 0.2), (3, 0, 0.0), (4, 0, 0.0), (5, None, None)]
    assert clusters.own_distance(v.limit(0), c).count() == 0 and clusters.own_distance(v, c.limit(0)).count() == 0
    assert {r.cluster: (r.n, r.total) for r in clusters.cluster_sums(v, c).collect()} == {0: (3, [3.0, 0.0]), 1: (1, [0.0, 1.0])}


def test_vectors_are_not_shuffled(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0])], "idx long, cluster int, vector array<double>")
    plan = clusters.own_distance(v, clusters.centroids(v))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_centroid_table_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MAX_MODEL", 3)
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], "cluster int, centroid array<double>")
    with pytest.raises(ValueError, match="more than 3 numbers"):
        clusters.model(c)


def test_merging_keeps_what_is_apart(spark):
    n = spark.createDataFrame([(1, 2, 0.05), (2, 1, 0.05), (3, 4, 0.1), (4, 3, 0.2), (5, 2, 0.01)], "cluster int, neighbour int, distance double")
    m = clusters.merge_pairs(n, 0.1)
    assert rows(m, "cluster") == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 1)]
    a = spark.createDataFrame([(1, 5, "x"), (2, 3, "y"), (3, 99, "z")], "idx long, cluster int, merged string")
    assert rows(clusters.relabel(a, m), "idx") == [(1, 1, "x"), (2, 3, "y"), (3, 99, "z")]
    assert rows(clusters.relabel(a, m, default=-1), "idx")[2] == (3, -1, "z")


def test_clashing_column_names_survive(spark):
    a = spark.createDataFrame([(i, 0, 0.1, 5, "q", 7, 8) for i in range(4)], ASSIGNED + ", rn int, q string, _b int, _r int")
    out = sampling.stratified(a, quotas.equal(stats.cluster_stats(a), 2, []))
    assert out.columns == a.columns and {(r.rn, r.q) for r in out.collect()} == {(5, "q")}
    split = sampling.split_fixed(a, 2, 1, 1)
    assert {(r["_b"], r["_r"]) for r in split.collect()} == {(7, 8)}
    o = shards.with_ordinal(a.withColumnRenamed("rn", "_p").withColumnRenamed("q", "_base"), "idx")
    assert rows(o.select("idx", "ordinal", "_p", "_base"), "idx") == [(i, i, 5, "q") for i in range(4)]


def test_ordinals_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("idx"))
    for n in (1, 9):
        assert shards.with_ordinal(df.repartition(n), "idx").filter("ordinal <> idx").count() == 0
    assert shards.with_ordinal(df.limit(0), "idx").count() == 0


def test_locating_in_strips_equals_searching(spark, monkeypatch):
    sizes = spark.createDataFrame([(i, 1 + i * i % 17) for i in range(200)], "shard long, n long")
    o = written(shards.offsets(sizes).withColumn("start", F.col("start") + 5), "offsets")
    df = spark.range(2000).select(F.col("id").alias("idx"))
    want = rows(shards.locate(df, o), "idx")
    assert want[4] == (4, None, None) and want[5] == (5, 0, 0)
    monkeypatch.setattr(shards, "MAX_STARTS", 40)
    assert rows(shards.locate(df, o), "idx") == want


# Sources and sinks


def test_broken_json_lines_are_kept_aside(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"idx": 1, "cluster": 2, "distance": 0.5}\n{"idx": 2, "clus\n\n{"idx": 3, "cluster": 2, "distance": 0.25}\n')
    good, bad = tables.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", tables.ASSIGNMENT)
    assert rows(good, "idx") == [(1, 2, 0.5), (3, 2, 0.25)] and rows(bad) == [('{"idx": 2, "clus',)]


def test_written_chunks_are_described(spark, at):
    a = spark.createDataFrame([(i, 0, 0.5) for i in range(25)], ASSIGNED).coalesce(1)
    assert rows(tables.write_chunks(a, at("chunks"), 10)) == [(3, 10, "cluster_results", 25)]


def test_sections(spark, at):
    df = spark.range(0, 100).select(F.col("id").alias("idx"))
    assert tables.write_section(shards.section(df, 1, 3, 10), at("s"), 1, 3, 10)
    assert not tables.write_section(shards.section(df, 1, 3, 10), at("s"), 1, 3, 10)  # finished: left as it is
    assert tables.read_sections(spark, at("s"), df.schema).count() == 20
    with pytest.raises(Exception, match="outside of the section"):
        tables.write_section(df, at("s"), 4, 5, 10)
    assert tables.write_section(shards.section(df, 4, 5, 10), at("s"), 4, 5, 10)  # a broken one is written anew
    assert tables.read_sections(spark, at("s"), df.schema).count() == 30


def test_first_shards_by_name(spark, at):
    spark.range(100).coalesce(1).write.option("maxRecordsPerFile", 10).parquet(at("p"))
    assert sorted(r.id for r in shards.first_shards(spark, at("p"), 3).collect()) == list(range(30))


def test_exclusions_losses_and_centroids_round_trip(spark, at):
    tables.write_exclusions(spark, [7, 3, 7], at("x"))
    assert tables.read_exclusions(spark, at("x")) == [3, 7]
    p = spark.createDataFrame([(2, 1.5, 10.0), (1, 0.5, 5.0)], "cluster int, mean_loss double, proportion double")
    tables.write_cluster_loss(p, at("l"))
    assert rows(tables.read_cluster_loss(spark, at("l")), "cluster") == [(1, 0.5, 5.0), (2, 1.5, 10.0)]
    c = spark.createDataFrame([(0, [0.5, 1.0])], "cluster int, centroid array<double>")
    tables.write_centroids(c, at("c"))
    assert rows(tables.read_centroids(spark, at("c"))) == [(0, [0.5, 1.0])]


def test_cluster_info_in_both_forms(spark, tmp_path, at):
    entry = {"closest": [{"text": "a", "distance": 0.1}], "farthest": [], "total_examples": 3, "average_distance": 0.2, "sum_distance": 0.6}
    (tmp_path / "info.json").write_text(json.dumps({"4": entry, "11": entry | {"total_examples": 5}}, indent=1))
    info = tables.read_cluster_info(spark, at("info.json"))
    assert [(r.cluster, r.closest[0].text, r.total_examples) for r in info.orderBy("cluster").collect()] == [(4, "a", 3), (11, "a", 5)]
    tables.write_cluster_info(info, at("again"))
    assert sorted(map(str, tables.read_cluster_info(spark, at("again")).collect())) == sorted(map(str, info.collect()))
    empty = tables.cluster_info(stat_table(spark, {1: 0}), spark.createDataFrame([], "cluster int, side string, rank int, idx long, distance double, text string"))
    assert empty.first().closest == [] == empty.first().farthest


def test_result_tables(spark, tmp_path, at):
    (tmp_path / "t.txt").write_text("|Tasks|Version|Filter|n-shot|Metric| |Value| |Stderr|\n|---|--:|---|--:|---|---|--:|---|--:|\n|arc|1|none|0|acc|up|0.25|+-|0.01|\n| | |none|0|acc_norm|up|0.3|+-|N/A|\n| - sub|2|none|5|acc|up|0.5|+-|0.02|\n")
    found = rows(tables.read_results(spark, at("t.txt")).select("task", "metric", "n_shot", "value", "stderr"))
    assert found == [("arc", "acc", 0, 0.25, 0.01), ("arc", "acc_norm", 0, 0.3, None), ("sub", "acc", 5, 0.5, 0.02)]


def test_distilled_folders(spark, at):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "idx long, text string")
    a = spark.createDataFrame([(i, i % 3, 0.1) for i in range(60)], ASSIGNED)
    config = distill.Config(30, (2,), "equal", "fixed", (20, 4, 6))
    out = distill.write_distilled(docs, a, stats.cluster_stats(a), config, at("d"), rows=7)
    assert rows(out.groupBy("split").count(), "split") == [("test", 6), ("train", 20), ("validation", 4)]
    assert all(r.text == f"text {r.pile_idx}" and r.pile_idx % 3 < 2 for r in out.collect())
    assert len([f for f in out.inputFiles() if "split=train" in f]) >= 3


def test_texts_beyond_the_broadcast_are_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "idx long, text string")
    sel = spark.createDataFrame([(i, "train") for i in range(0, 60, 7)], "idx long, split string")
    few = rows(distill.with_texts(sel, docs), "pile_idx")
    assert "Exchange hashpartitioning" not in distill.with_texts(sel, docs)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(distill, "FEW", 3)
    assert rows(distill.with_texts(sel, docs), "pile_idx") == few


# Losses, tokens, embeddings


def test_unigram_loss_with_hot_words(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, ""), (4, None)], "idx long, text string")
    want = rows(losses.unigram_loss(docs), "idx")
    p = {"a": 3 / 5, "b": 1 / 5, "c": 1 / 5}
    cost = lambda ws: -sum(math.log(p[w]) for w in ws) / len(ws)
    assert [x for _, x in want] == pytest.approx([cost("aab"), cost("ac"), 0, 0], abs=1e-6)
    monkeypatch.setattr(losses, "OFTEN", 2)  # only "a" is often now
    assert rows(losses.unigram_loss(docs), "idx") == want


def test_scoring_with_a_model_of_the_callers(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "idx long, text string")
    assert rows(losses.scored_by(docs, lambda: lambda texts: [float(len(t)) for t in texts]), "idx") == [(1, 3.0), (2, 0.0)]


def test_token_lengths_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["hello world, this is text", "", None, "x " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    t = written(tokens.tokenised(docs, path, 10), "tokens")
    want = [Tokenizer.from_file(path).encode(x or "", add_special_tokens=False).ids for x in texts]
    assert rows(t, "idx") == [(i, x[:10], len(x)) for i, x in enumerate(want)]
    s = tokens.length_stats(t, 10).first()
    assert (s.documents, s.tokens, s.min_length, s.max_length, s.cut) == (4, sum(map(len, want)), 0, len(want[3]), 1)
    assert tuple(tokens.length_stats(t.limit(0)).first()) == (0, 0, None, None, None, 0)


def test_embeddings_equal_the_encoder(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "idx long, text string")
    found = {r.idx: r.embedding for r in embedding.embed(docs).collect()}
    m = embedding.hashed()(["query: a b"])[0]
    assert found[1] == pytest.approx((m / math.sqrt(m @ m)).tolist(), abs=1e-6) and found[3] is None and len(found[2]) == 64


def test_shared_paths_are_fresh(spark):
    assert shared_path(spark, "x") != shared_path(spark, "x") and shared_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, ROOT := str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])  # for the Python workers

from pyspark.sql import SparkSession  # noqa: E402

from corpusmith import catalog  # noqa: E402

NAMES = ["distill_density", "assign_clusters", "cluster_extremes", "cluster_stats", "quota_inter", "quota_low_topup", "topup_union", "threshold_mask", "unigram_loss", "loss_topn", "top_words", "word_count_hist", "dataset_bytes", "split_ratio", "extract_text", "shard_locate", "kmeans_fit", "embed_stub"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = dict(catalog.queries()), {}
    names = list(NAMES)
    try:
        from corpusmith.llm import queries as training
    except ModuleNotFoundError as e:
        if e.name != "corpusmith.llm":
            raise
    else:
        queries |= training.queries()
        names += sorted(training.queries(), key=lambda n: int(n[2:].split("_")[0]))
    catalog.queries()["cluster_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    for name in names:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, wall-clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Readers with fixed schemas and writers bounded in size. Everything goes through Spark's own readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGNMENT = "idx BIGINT, cluster INT, distance DOUBLE"
CENTROIDS = "cluster INT, centroid ARRAY<DOUBLE>"
CLUSTER_LOSS = "cluster_idx INT, mean_loss DOUBLE, proportion DOUBLE"
EMBEDDED = "idx BIGINT, embedding ARRAY<FLOAT>, text STRING"
EXAMPLES = "ARRAY<STRUCT<text: STRING, distance: DOUBLE>>"
INFO = f"closest {EXAMPLES}, farthest {EXAMPLES}, total_examples BIGINT, average_distance DOUBLE, sum_distance DOUBLE"
CLUSTER_INFO = f"cluster INT, {INFO}"


def read_splits(spark: SparkSession, paths: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """Several splits as one table with a ``split`` column; ``columns``: only these of each."""
    parts = [spark.read.parquet(p).select(*(columns or ["*"])).withColumn("split", F.lit(name)) for name, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The good rows of JSON lines, and the broken lines as ``_bad``."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = lines.select(F.from_json("value", f"{schema}, _bad STRING", how).alias("r")).select("r.*")
    return rows.filter("_bad is null").drop("_bad"), rows.filter("_bad is not null").select("_bad")


def write_jsonl(df: DataFrame, path: str, rows: int = 1_000_000, by: str | None = None) -> None:
    """JSON lines of at most ``rows`` a file; ``by``: a folder for each value of that column."""
    out = df.write.mode("overwrite").option("maxRecordsPerFile", rows)
    (out.partitionBy(by) if by else out).json(path)


def write_parquet(df: DataFrame, path: str, rows: int = 100_000, by: str | None = None) -> None:
    """Parquet files of at most ``rows`` rows, for instance a folder for each split."""
    out = df.write.mode("overwrite").option("maxRecordsPerFile", rows)
    (out.partitionBy(by) if by else out).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result table with ``|`` between cells: ``task, version, filter, n_shot, metric, direction, value, stderr``. A
    blank task is that of the row above within its file; the header and the rule are left out; a value that is no
    number is null."""
    cells = F.transform(F.split("value", r"\|"), lambda c: F.trim(c))
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    rows = lines.withColumn("c", cells).filter((F.size("c") >= 10) & ~F.col("c")[1].isin("Tasks") & ~F.col("value").rlike(r"^\|[-:| ]+\|?$"))
    from pyspark.sql import Window

    above = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    task = F.last(F.when(F.col("c")[1] != "", F.regexp_replace(F.col("c")[1], r"^[-\s]+", "")), ignorenulls=True).over(above)
    number = lambda k: F.col("c")[k].try_cast("double")
    return rows.select(task.alias("task"), F.col("c")[2].try_cast("int").alias("version"), F.col("c")[3].alias("filter"), F.col("c")[4].try_cast("int").alias("n_shot"), F.col("c")[5].alias("metric"), F.col("c")[6].alias("direction"), number(7).alias("value"), number(9).alias("stderr"))


def write_chunks(df: DataFrame, path: str, chunk_size: int = 1_000_000, prefix: str = "cluster_results") -> DataFrame:
    """Assignments as JSON lines of at most ``chunk_size`` a file, and beside them (``path``-metadata) one row about what
    was written: ``total_chunks`` (files), ``chunk_size, prefix, total_entries``. Returns that row."""
    write_jsonl(df, path, chunk_size)
    spark = df.sparkSession
    back = spark.read.schema(df.schema).json(path)
    about = back.agg(F.count("*").alias("total_entries")).select(F.lit(len(back.inputFiles())).cast("long").alias("total_chunks"), F.lit(chunk_size).cast("long").alias("chunk_size"), F.lit(prefix).alias("prefix"), "total_entries")
    about.coalesce(1).write.mode("overwrite").json(f"{path}-metadata")
    return spark.read.schema(about.schema).json(f"{path}-metadata")


def cluster_info(stats: DataFrame, examples: DataFrame) -> DataFrame:
    """The published form, a row per cluster: statistics with the closest and farthest examples in order."""
    lists = examples.groupBy("cluster", "side").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text", "distance"))), lambda x: F.struct(x["text"].alias("text"), x["distance"].alias("distance"))).alias("l"))  # a few rows a cluster
    none = F.array().cast("array<struct<text:string,distance:double>>")
    side = lambda s: lists.filter(F.col("side") == s).select("cluster", F.col("l").alias(s))
    both = stats.join(side("closest"), "cluster", "left").join(side("farthest"), "cluster", "left")
    return both.select("cluster", F.coalesce("closest", none).alias("closest"), F.coalesce("farthest", none).alias("farthest"), "total_examples", "average_distance", "sum_distance")


def write_cluster_info(info: DataFrame, path: str) -> None:
    """A JSON line per cluster: a table of model size, in one file."""
    info.orderBy("cluster").coalesce(1).write.mode("overwrite").json(path)


def read_cluster_info(spark: SparkSession, path: str) -> DataFrame:
    """Cluster information as :func:`write_cluster_info` leaves it, or one JSON object with a member for each cluster number."""
    lines = spark.read.schema(CLUSTER_INFO).json(path).filter("cluster is not null")
    if not lines.isEmpty():
        return lines
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"MAP<STRING, STRUCT<{INFO}>>")).alias("k", "v"))
    return whole.select(F.col("k").cast("int").alias("cluster"), "v.*")


def write_cluster_loss(proportions: DataFrame, path: str) -> None:
    """``cluster, mean_loss, proportion`` as JSON lines under the published names, in one file."""
    proportions.select(F.col("cluster").alias("cluster_idx"), "mean_loss", "proportion").orderBy("cluster_idx").coalesce(1).write.mode("overwrite").json(path)


def read_cluster_loss(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CLUSTER_LOSS)[0].withColumnRenamed("cluster_idx", "cluster")


def write_exclusions(spark: SparkSession, clusters: list[int], path: str) -> None:
    """The excluded clusters, sorted and each once, as one JSON line."""
    spark.createDataFrame([(sorted(set(clusters)),)], "excluded_clusters ARRAY<INT>").coalesce(1).write.mode("overwrite").json(path)


def read_exclusions(spark: SparkSession, path: str) -> list[int]:
    rows = spark.read.schema("excluded_clusters ARRAY<INT>").json(path).collect()
    return sorted({c for r in rows for c in r.excluded_clusters or []})


def write_centroids(centers: DataFrame, path: str) -> None:
    centers.select(F.col("cluster").cast("int"), F.col("centroid").cast("array<double>")).coalesce(1).write.mode("overwrite").parquet(path)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CENTROIDS).parquet(path)


def write_section(df: DataFrame, path: str, first: int, last: int, size: int, key: str = "idx", rows: int = 100_000) -> bool:
    """The rows of sections ``first`` to ``last`` (exclusive) of ``size`` rows into a folder of their own. A finished folder
    (Spark leaves a marker in it) is left as it is and gives False; rows outside of the range are an error."""
    out = f"{path.rstrip('/')}/{first:06d}-{last:06d}"
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    marker = jvm.org.apache.hadoop.fs.Path(f"{out}/_SUCCESS")
    if marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(marker):
        return False
    outside = (F.col(key) < first * size) | (F.col(key) >= last * size) | F.col(key).isNull()
    guarded = df.withColumn(key, F.when(outside, F.raise_error(F.lit("a row outside of the section"))).otherwise(F.col(key)))
    guarded.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(out)
    return True


def read_sections(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/*-*")

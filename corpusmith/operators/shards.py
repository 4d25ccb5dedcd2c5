"""Positions: ordinals, shard offsets, the shard that holds a row, slices and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

#: Starts of shards (16 bytes each) that go to the tasks in one array.
MAX_STARTS = 1_000_000


def with_ordinal(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """A 0-based position in the order of unique columns: range partitions count their rows, then each adds those
    before it; no task sees all rows."""
    # Written once, so that a row's partition is the same in both branches.
    ranged = written(df.repartitionByRange(*order).withColumn("_cs_p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_cs_p").agg(F.count("*").alias("_cs_n"))
    before = Window.orderBy("_cs_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_cs_p", F.coalesce(F.sum("_cs_n").over(before), F.lit(0)).alias("_cs_base"))  # a row a partition
    rank = F.row_number().over(Window.partitionBy("_cs_p").orderBy(*order))
    return ranged.join(F.broadcast(bases), "_cs_p").withColumn(name, rank - 1 + F.col("_cs_base")).drop("_cs_p", "_cs_base")


def shard_sizes(df: DataFrame, size: int, key: str = "idx") -> DataFrame:
    """``shard, n`` of rows dealt to shards of ``size`` ids."""
    return df.groupBy(F.expr(f"{key} div {size}").alias("shard")).agg(F.count("*").alias("n"))


def offsets(sizes: DataFrame) -> DataFrame:
    """``shard, n, start``: the rows of all shards before each. A row per shard: a table of file size."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def mixed_offsets(spark, head: tuple[int, int], tail: tuple[int, int], last: int) -> DataFrame:
    """Offsets of shards of which the first are of one size, the next of another, and the last of its own."""
    sizes = [head[1]] * head[0] + [tail[1]] * tail[0] + [last]
    return offsets(spark.createDataFrame(list(enumerate(sizes)), "shard long, n long"))


def locate(rows: DataFrame, shards: DataFrame, idx: str = "idx") -> DataFrame:
    """Adds ``shard`` and ``local``: the last shard that starts at or before the row's index; null before the first and for
    a null index. Up to ``MAX_STARTS`` starts (shards are files) go to the tasks as one sorted array, which is searched
    by halves; more are first found in strips of the index, joined by the strip's number. No row is shuffled for the former."""
    starts = shards.filter("start is not null").select(F.col("start").cast("long"), F.col("shard").cast("long"))
    n, last = starts.agg(F.count("*"), F.max("start")).first()
    if n <= MAX_STARTS:
        return _searched(rows, sorted(starts.collect()), idx)
    wide = last // (MAX_STARTS // 4) + 1
    strips = starts.groupBy(F.expr(f"start div {wide}").alias("_cs_s")).agg(F.sort_array(F.collect_list(F.struct("start", "shard"))).alias("_cs_l"), F.max(F.struct("start", "shard")).alias("_cs_m"))
    before = Window.orderBy("_cs_s").rowsBetween(Window.unboundedPreceding, -1)  # a row a strip
    every = rows.sparkSession.range(last // wide + 1).select(F.col("id").alias("_cs_s")).join(strips, "_cs_s", "left")
    every = every.withColumn("_cs_o", F.last("_cs_m", ignorenulls=True).over(before)).drop("_cs_m")
    strip = F.least(F.expr(f"`{idx}` div {wide}"), F.lit(last // wide))
    own = F.try_element_at(F.filter("_cs_l", lambda x: x["start"] <= F.col(f"`{idx}`")), F.lit(-1))
    found = rows.withColumn("_cs_s", strip).join(every, "_cs_s", "left")
    found = found.withColumn("_cs_h", F.coalesce(own, "_cs_o"))
    return found.withColumns({"shard": F.col("_cs_h.shard"), "local": F.col(f"`{idx}`") - F.col("_cs_h.start")}).drop("_cs_s", "_cs_l", "_cs_o", "_cs_h")


def _searched(rows: DataFrame, starts: list, idx: str) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    at, shard = (np.array([r[k] for r in starts], np.int64) for k in range(2))
    names = [c for c in rows.columns if c not in ("shard", "local")]

    def run(batches):
        for batch in batches:
            i = batch.column(names.index(idx))
            known = i.is_valid().to_numpy(zero_copy_only=False)
            v = i.cast(pa.int64()).fill_null(0).to_numpy()
            k = np.searchsorted(at, v, "right") - 1
            none = ~known | (k < 0)
            k = np.maximum(k, 0)
            more = [pa.array(x if len(at) else np.zeros(len(v), np.int64), mask=none) for x in ((shard[k], v - at[k]) if len(at) else (v, v))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "shard", "local"])

    plain = rows.select(*[F.col(f"`{c}`") for c in names])
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("shard", T.LongType()), T.StructField("local", T.LongType())]))


def first_shards(spark, path: str, most: int) -> DataFrame:
    """The rows of the first ``most`` files by name of a Parquet folder."""
    return spark.read.parquet(*sorted(spark.read.parquet(path).inputFiles())[:most])


def resume_after(df: DataFrame, done: int, key: str = "idx") -> DataFrame:
    """The rows that earlier output does not hold, given how many it holds."""
    return df.filter(F.col(key) >= done)


def section(df: DataFrame, first: int, last: int, size: int, key: str = "idx") -> DataFrame:
    """The rows of sections ``first`` to ``last`` (exclusive) of ``size`` rows."""
    return df.filter((F.col(key) >= first * size) & (F.col(key) < last * size))


def not_done(df: DataFrame, done: DataFrame, key: str = "idx") -> DataFrame:
    return df.join(done.select(key), key, "left_anti")

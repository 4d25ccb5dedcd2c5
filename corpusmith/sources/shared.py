"""Tables that are written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder; a cluster
    has to name one, as its machines do not see each other's folders."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        home = "file://" + tempfile.mkdtemp(prefix="corpusmith-")
        spark.conf.set("spark.checkpoint.dir", home)
    return f"{home.rstrip('/')}/corpusmith/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once and read back: later steps do not run its chain again, and a lost executor costs
    its unfinished tasks only."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

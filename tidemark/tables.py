"""Tables written between the steps of an iterative job, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a temporary one on a single machine; an error on a cluster."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or spark.conf.get("tidemark.scratch", None)
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.scratch", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors. ``files``: at most so many, for small tables of an iteration."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    out = spark.read.schema(T.StructType(list(df.schema))).parquet(path)
    out._tidemark_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` returned and no later plan reads."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, for a table that is narrow: two files a core."""
    return written(df, name, 2 * df.sparkSession.sparkContext.defaultParallelism)

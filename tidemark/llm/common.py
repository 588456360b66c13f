"""Shared pieces of the training-data operators: the shared scratch folder, table names, word patterns."""

from __future__ import annotations

import contextlib
import json
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import readers

# What separates words, and what is stripped from lines.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

#: Rows in one Arrow batch, where the session leaves Spark's default of 10,000.
ARROW_ROWS = 256

#: Keys with more than one in HOT of all rows are joined apart.
HOT = 1024

#: Tables written since each open ``passing`` began.
_WRITTEN: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return readers.table(spark, sf_dir, name, spread=name == "documents")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it. Where it is unset, a temporary one on a single machine; an error on a cluster."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or spark.conf.get("tidemark.scratch", None)
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.scratch", root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str, partition_by: str | None = None, compact: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    ``compact`` is for the many narrow tables of an iteration: two files for each core, however many partitions a
    shuffle has, so that every core has work and rounds do not leave thousands of small files.
    """
    spark = df.sparkSession
    if compact:
        df = df.coalesce(max(1, 2 * spark.sparkContext.defaultParallelism))
    path = f"{scratch_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(T.StructType(sorted(df.schema, key=lambda f: f.name == partition_by))).parquet(path)
    out._tidemark_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` returned and no later plan reads; of any other table, nothing."""
    if path := getattr(df, "_tidemark_path", None):
        delete(df.sparkSession, path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at its end, the tables written inside; those whose names are put in the list stay."""
    keep: list[str] = []
    _WRITTEN.append([])
    try:
        yield keep
    finally:
        for path in _WRITTEN.pop():
            if path.rsplit("/", 1)[1].rsplit("-", 1)[0] not in keep:
                delete(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that operators have left in the shared folder. For the end of a session: results that were not written yet need them."""
    delete(spark, f"{scratch_root(spark)}/tidemark")


def small_table(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """A driver-made table of a few rows as a plan without Python serialisation."""
    text = json.dumps([dict(zip(schema.names, r)) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), T.ArrayType(schema))))


def join_apart(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join with a written table of distinct keys, whose column ``count`` says how many rows of ``left`` a key has.

    Keys with more than 1 / ``HOT`` of all counts, of which there are fewer than ``HOT``, go by broadcast: the rows of a
    hot key stay where they are. The others go by a plain equi-join.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = right.where(F.col(count) * HOT > total)
    marked = left.join(F.broadcast(hot.select(*keys, F.lit(True).alias("__tm_hot"))), keys, "left")
    few = marked.where("__tm_hot").drop("__tm_hot").join(F.broadcast(hot), keys)
    return few.unionByName(marked.where("__tm_hot is null").drop("__tm_hot").join(right, keys))


def position(*parts: Column | str) -> Column:
    """A point in [0, 2^60) that depends on the parts alone; any engine with md5 can recompute it."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("~")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def arrow_batches(spark: SparkSession) -> None:
    """Rows in an Arrow batch handed to Python, unless the session has set its own number.

    The kernels hold texts by bytes, but Spark's own buffers, two for each running task, are as large as a batch; the
    number can only be set for the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))

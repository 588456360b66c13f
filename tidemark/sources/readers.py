"""Reading: CSV with a stated schema, fallback chains, file discovery, Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns])


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
PAPERS = schema(*[(c, _S) for c in ("paper_id", "title", "abstract", "published", "primary_category", "categories", "authors", "entry_url", "query_category")])
CHANGE_POINTS = schema(("category", _S), ("date", _S), ("method", _S))
TRENDS = schema(("tier", _S), ("topic_id", _I), ("mk_tau", _D), ("mk_pvalue", _D), ("ts_slope", _D), ("ts_slope_lo", _D), ("ts_slope_hi", _D), ("significant", _B))
KEYWORDS = schema(("topic_id", _I), ("rank", _I), ("keyword", _S), ("weight", _D))
MACRO = schema(("tier", _S), ("topic_id", _I), ("paper_count", _L), ("macro_id", _I), ("top5_kw", _S), ("tier_label", _S))
EVOLUTION = schema(("global_topic", _I), ("event", _S), ("prev_clusters", _D), ("next_clusters", _D), ("prev_papers", _D), ("next_papers", _D), ("merged_topics", _S))


def read_csv(spark: SparkSession, path: str, columns: T.StructType, strict: bool = False) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; malformed rows fail (strict) or are dropped. A byte order mark is no part of the first name."""
    reader = spark.read.schema(columns).options(header=True, multiLine=True, escape='"', enforceSchema=True, mode="FAILFAST" if strict else "DROPMALFORMED")
    return reader.csv(path)


def read_csv_apart(spark: SparkSession, path: str, columns: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed rows): as ``read_csv``, with what it would drop kept apart - the file, where in the order of its malformed rows, the text, what could be parsed - for a table of its own."""
    options = {"header": True, "multiLine": True, "escape": '"', "enforceSchema": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed", "columnPruning": False}
    whole = spark.read.schema(T.StructType([*columns, T.StructField("_malformed", T.StringType())])).options(**options).csv(path)
    bad = whole.where("_malformed is not null").select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_at"), F.col("_malformed").alias("record"), F.to_json(F.struct(*columns.names)).alias("parsed"))
    order = Window.partitionBy("file").orderBy("_at")
    return whole.where("_malformed is null").drop("_malformed"), bad.select("file", F.row_number().over(order).alias("number"), "record", "parsed")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {list(paths)} exists")


def find_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, on any file system, sorted."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().toString() for f in found or [])


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order; files have none of their own."""
    return df.orderBy(*order).limit(n)


def merged_topics(df: DataFrame) -> DataFrame:
    """The bracketed list of an evolution table as integers."""
    return df.withColumn("merged_topics", F.from_json("merged_topics", T.ArrayType(T.IntegerType())))


#: Tables below this many bytes may be one row group, which is one task whatever the cores.
SMALL_TABLE = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A Parquet table of a folder. ``spread`` deals the rows of a small one over all cores, for work that is heavy by row."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if spread:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength() < SMALL_TABLE:
            df = df.repartition(spark.sparkContext.defaultParallelism)
    return df

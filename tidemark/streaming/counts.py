"""Counts over event-time windows as a stream: the running twin of the monthly counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.tables import shared_root


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """(category, start, count) of tumbling, or sliding, windows; rows later than the watermark are left out."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    known = stream.where(F.col(ts).isNotNull() & F.col(key).isNotNull())
    return known.withWatermark(ts, late).groupBy(w.alias("w"), F.col(key).alias("category")).agg(F.count(F.lit(1)).alias("count")).select("category", F.col("w.start").alias("start"), "count")


def session_counts(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(category, start, end, count) of sessions that end after a gap."""
    known = stream.where(F.col(ts).isNotNull() & F.col(key).isNotNull())
    w = F.session_window(ts, gap)
    return known.withWatermark(ts, late).groupBy(w.alias("w"), F.col(key).alias("category")).agg(F.count(F.lit(1)).alias("count")).select("category", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")


def read_stream(spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet", files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as they come, those whose names match."""
    return spark.readStream.schema(schema).options(maxFilesPerTrigger=files_per_trigger, pathGlobFilter=files).parquet(folder)


def latest_table(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``path`` at the newest complete result: each batch overwrites it."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return result.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(result: DataFrame, root: str) -> DataFrame:
    """Runs a stream over all that is there now and reads its result."""
    name = uuid.uuid4().hex
    path = f"{root}/stream-{name}"
    latest_table(result, path, f"{root}/stream-{name}-checkpoint").awaitTermination()
    return result.sparkSession.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one on a single machine where it is unset; an error on a cluster."""
    return shared_root(spark)

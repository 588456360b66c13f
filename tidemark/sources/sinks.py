"""Writing: Parquet tables, CSV exports, JSON reports."""

from __future__ import annotations

import logging
from datetime import datetime
from collections.abc import Sequence

from pyspark.ml.util import MLWritable
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

LOG = logging.getLogger("tidemark")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, byte_order_mark: bool = True) -> None:
    """An export for spreadsheets: one file with a header and, if wanted, a byte order mark. For small results."""
    columns = list(df.columns)
    if byte_order_mark and columns:
        df = df.toDF("﻿" + columns[0], *columns[1:])
    df.coalesce(1).write.mode("overwrite").options(header=True, escape='"').csv(path)


def melt(df: DataFrame, key: str, variable: str = "variable", value: str = "value") -> DataFrame:
    """A wide table as (key, variable, value), which any sink takes."""
    names = [c for c in df.columns if c != key]
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias(variable), F.col(n).alias(value)) for n in names])).alias("x")).select(key, "x.*")


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def as_json(df: DataFrame, column: str = "report") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def write_counted(df: DataFrame, path: str, name: str, **measures: Column) -> dict:
    """Writes Parquet and returns, from the same pass, the number of rows and any further aggregates; logs them."""
    seen = Observation(name)
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in measures.items()]).write.mode("overwrite").parquet(path)
    LOG.info("%s %s", name, seen.get)
    return seen.get


def log_summary(name: str, df: DataFrame, rows: int = 20) -> None:
    for r in df.limit(rows).collect():
        LOG.info("%s %s", name, r.asDict())


def stamp(now: datetime | None = None) -> str:
    """The time of a log line, to the second."""
    return (now or datetime.now()).isoformat(" ", "seconds")


def under(root: str, path: str) -> str:
    """``path`` below ``root`` unless it is absolute or names a file system."""
    return path if path.startswith("/") or "://" in path else f"{root.rstrip('/')}/{path}"

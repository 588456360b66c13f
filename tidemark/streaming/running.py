"""Stateful analyses over closed windows of counts: trailing means and bursts as the stream goes.

Input are rows (category, start, count) of windows that the watermark has closed, so a category's rows come in order of time
across batches, and in any order within one. State is the last ``window`` counts of a category, and its open run. A row too late
for its window is in no count. A category that falls silent for ``quiet`` of event time ends its open run, without an end, and
gives up its state.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TRAILING = "category string, start timestamp, count long, mean double, n long"
BURSTS = "category string, start timestamp, end timestamp, peak timestamp, peak_count long, rows long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("start")


class Trailing(StatefulProcessor):
    """Each row with the mean of the last ``window`` counts, itself included."""

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "count long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = [r[0] for r in self.last.get()] if self.last.exists() else []
        out = []
        for start, count in in_order(rows)[["start", "count"]].itertuples(index=False):
            last = [*last, int(count)][-self.window :]
            out.append((key[0], start, int(count), sum(last) / len(last), len(last)))
        self.last.put([(c,) for c in last])
        yield pd.DataFrame(out, columns=["category", "start", "count", "mean", "n"])

    def close(self) -> None:
        pass


class Bursts(StatefulProcessor):
    """Runs of rows above mean + ``sigma`` deviations of the ``window`` rows before each; a run ends at the first row that is not."""

    def __init__(self, window: int, sigma: float, min_rows: int, quiet_ms: int) -> None:
        self.window, self.sigma, self.min_rows, self.quiet_ms = window, sigma, min_rows, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "count long")
        self.open = handle.getValueState("open", "start timestamp, peak timestamp, peak_count long, rows long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = [r[0] for r in self.last.get()] if self.last.exists() else []
        run = tuple(self.open.get()) if self.open.exists() else None
        out, start = [], None
        for start, count in in_order(rows)[["start", "count"]].itertuples(index=False):
            count, n = int(count), len(last)
            mean = sum(last) / n if n else 0.0
            spread = (sum((c - mean) ** 2 for c in last) / n) ** 0.5 if n else 0.0
            if n >= self.min_rows and count > mean + self.sigma * spread:
                first, peak, most, k = run or (start, start, count, 0)
                run = (first, start if count > most else peak, max(count, most), k + 1)
            elif run:
                out.append((key[0], run[0], start, run[1], run[2], run[3]))
                run = None
            last = [*last, count][-self.window :]
        self.last.put([(c,) for c in last])
        if run:
            self.open.update((pd.Timestamp(run[0]).to_pydatetime(), pd.Timestamp(run[1]).to_pydatetime(), run[2], run[3]))
        else:
            self.open.clear()
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(pd.Timestamp(start).timestamp() * 1000) + self.quiet_ms)
        yield self.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = tuple(self.open.get()) if self.open.exists() else None
        self.open.clear()
        self.last.clear()
        yield self.frame([(key[0], run[0], None, run[1], run[2], run[3])] if run else [])

    @staticmethod
    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["category", "start", "end", "peak", "peak_count", "rows"])
        return out.astype({"start": "datetime64[us]", "end": "datetime64[us]", "peak": "datetime64[us]"})

    def close(self) -> None:
        pass


def trailing_means(counts: DataFrame, window: int = 12) -> DataFrame:
    """category, start, count, mean, n: G8's trailing mean of a stream of closed counts."""
    return counts.groupBy("category").transformWithStateInPandas(Trailing(window), outputStructType=TRAILING, outputMode="append", timeMode="none")


def bursts(counts: DataFrame, window: int = 12, sigma: float = 2.0, min_rows: int = 6, quiet_days: int = 30) -> DataFrame:
    """category, start, end, peak, peak_count, rows: runs of unusual counts as they end."""
    return counts.groupBy("category").transformWithStateInPandas(Bursts(window, sigma, min_rows, quiet_days * 86_400_000), outputStructType=BURSTS, outputMode="append", timeMode="eventTime")


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that such processors need, for the streams started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_appended(result: DataFrame, root: str) -> DataFrame:
    """Runs a stream of final rows over all that is there now and reads them."""
    name = f"{root}/stream-{uuid.uuid4().hex}"
    with keyed_state(result.sparkSession):
        query = result.writeStream.format("parquet").outputMode("append").option("path", name).option("checkpointLocation", f"{name}-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(name)


"""Fetching a paged web interface: a data source whose partitions are ranges of pages of a query, kept so that a restart goes on.

``fetch`` stores each answer as a row (query, start, status, body) of a Parquet table. A run plans the pages that the table
does not hold yet, reads them with pauses, retries and growing back-off, and appends what it got; pages that failed to the end
are stored as such and planned again by the next run. So after a restart no page is lost, and none that succeeded is read twice.
A query ends at its first page with fewer entries than asked for; pages beyond are planned only up to the stated number.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources import readers

PAGES = T.StructType([T.StructField("query", T.StringType()), T.StructField("start", T.LongType()), T.StructField("status", T.StringType()), T.StructField("tries", T.IntegerType()), T.StructField("body", T.StringType())])
FORMAT = "tidemark_pages"
#: Answers that another try may mend.
AGAIN = {408, 425, 429, 500, 502, 503, 504}

# What an entry of the feed holds, as the analyses name it.
FEED = (
    "entry array<struct<id:string,title:string,summary:string,published:string,primary_category:struct<_term:string>,"
    "category:array<struct<_term:string>>,author:array<struct<name:string>>>>"
)


class Range(InputPartition):
    def __init__(self, query: str, starts: list[int]) -> None:
        super().__init__((query, starts))
        self.query, self.starts = query, starts


def get(url: str, tries: int, wait: float, pause: Callable[[float], None] = time.sleep) -> tuple[str, int, str | None]:
    """(status, tries, body): waits ``wait`` seconds, doubled each time, before another try; or as long as the answer asks for."""
    status = "unread"
    for k in range(1, tries + 1):
        hold = wait * 2 ** (k - 1)
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                return "ok", k, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            status = f"http {e.code}"
            if e.code not in AGAIN:
                return status, k, None
            hold = max(hold, float(e.headers.get("Retry-After") or 0) if (e.headers.get("Retry-After") or "0").isdigit() else 0)
        except OSError as e:
            status = f"failed {type(e).__name__}"
        if k < tries:
            pause(hold)
    return status, tries, None


class Pages(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Range]:
        size = int(self.options.get("pages_per_task", 20))
        plan = json.loads(self.options["plan"])
        return [Range(q, starts[i : i + size]) for q, starts in plan for i in range(0, len(starts), size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        o = self.options
        for n, start in enumerate(partition.starts):
            if n:
                time.sleep(float(o.get("pause", 0)))
            asked = urllib.parse.urlencode({"search_query": partition.query, "start": start, "max_results": o["page_size"]})
            status, tries, body = get(f"{o['url']}?{asked}", int(o.get("max_retries", 5)), float(o.get("wait", 1)))
            yield partition.query, start, status, tries, body
            if body is not None and body.count(o.get("entry", "<entry")) < int(o["page_size"]):
                break  # the query's end


class PagedSource(DataSource):
    """Options: url, plan (JSON list of (query, starts)), page_size, pages_per_task, pause, wait, max_retries, entry (what an entry opens with)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return PAGES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Pages(dict(self.options))


def pending(done: DataFrame | None, queries: Sequence[str], page_size: int, max_rows: int, entry: str = "<entry") -> list[tuple[str, list[int]]]:
    """Pages that are not stored yet, up to each query's known end."""
    held: dict[str, set[int]] = {q: set() for q in queries}
    ends: dict[str, int] = {}
    if done is not None:
        short = F.length("body") - F.length(F.replace("body", F.lit(entry), F.lit(""))) < page_size * len(entry)
        per = done.where("status = 'ok'").groupBy("query").agg(F.collect_set("start").alias("starts"), F.min(F.when(short, F.col("start"))).alias("end"))
        for r in per.collect():  # a number a page
            held[r["query"]] = set(r["starts"])
            if r["end"] is not None:
                ends[r["query"]] = r["end"]
    plan = [(q, [s for s in range(0, max_rows, page_size) if s not in held[q] and s <= ends.get(q, max_rows)]) for q in dict.fromkeys(queries)]
    return [(q, starts) for q, starts in plan if starts]


def fetch(spark: SparkSession, path: str, url: str, queries: Sequence[str], page_size: int = 100, max_rows: int = 2000, pause: float = 5, wait: float = 5, max_retries: int = 5, pages_per_task: int = 20) -> DataFrame:
    """The stored pages after one more run over what is missing. Each page has one row with status ok at most."""
    done = spark.read.schema(PAGES).parquet(path) if readers.exists(spark, path) else None
    plan = pending(done, queries, page_size, max_rows)
    if plan:
        spark.dataSource.register(PagedSource)
        options = {"url": url, "plan": json.dumps(plan), "page_size": page_size, "pages_per_task": pages_per_task, "pause": pause, "wait": wait, "max_retries": max_retries}
        spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load().write.mode("append").parquet(path)
    return spark.read.schema(PAGES).parquet(path)


def papers(pages: DataFrame) -> DataFrame:
    """The entries of all stored pages as rows of the papers table, with the query that found them; a paper found twice is there twice."""
    entries = pages.where("status = 'ok'").select("query", F.explode(F.from_xml("body", FEED, {"ignoreNamespace": "true"})["entry"]).alias("e"))
    categories = F.array_join(F.col("e.category._term"), "|")
    return entries.select(
        F.element_at(F.split("e.id", "/abs/"), -1).alias("paper_id"), F.col("e.title").alias("title"), F.col("e.summary").alias("abstract"), F.col("e.published").alias("published"),
        F.col("e.primary_category._term").alias("primary_category"), categories.alias("categories"), F.array_join(F.col("e.author.name"), "|").alias("authors"), F.col("e.id").alias("entry_url"), F.col("query").alias("query_category"),
    )

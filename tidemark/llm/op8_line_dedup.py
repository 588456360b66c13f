"""Line dedup on levelled sorted runs of line hashes.

Lines are hashed once (128 bits of the normalised line). Batches of documents are then ingested one after the other: a
batch's keys are counted, merge-anti-joined with the settled runs (keys already known to be frequent need no more
counting), and added as a sorted run of (key, documents) at level 0. Whenever a level holds two runs they are merged
into one run of the next level, and its keys that have reached ``min_docs`` are settled from then on. At the end the
runs that are left are merged once more; the settled keys are the frequent lines, and every one of their lines goes from
every document.

A run is a table bucketed and sorted by its key, in as many buckets as the session's shuffles have partitions. So a
batch pays one exchange, of counts that were added up before it; the anti-joins and the merges (full outer merge joins)
have none. The tables lie in the shared folder, and their names are dropped with the last use. Jobs run while the
result is being built.

A line's key is the line stripped of blanks with A-Z lower-cased; keys shorter than ``min_chars`` never count. Each row
counts as a document, also where rows share an id, or id and text (these share one verdict). Null or empty text is one
empty line; an empty table gives an empty result. Hot keys are joined back to their documents apart from the others
(``join_apart``). A document's lines are looked up in its dropped keys by buckets, about the square root of their
number, so very long texts take little more than linear time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, delete, join_apart, materialise, scratch_root, table

# Letters that fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


class LineRuns:
    """Levels of runs (h1, h2, n), each a table bucketed and sorted by the key. Settled keys stay in the run that brought them to ``min_docs``."""

    def __init__(self, spark: SparkSession, min_docs: int) -> None:
        self.spark, self.min_docs = spark, min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []

    def _write(self, df: DataFrame) -> str:
        name = f"tidemark_run_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        writer.option("path", f"{scratch_root(self.spark)}/tidemark/{name}").saveAsTable(name)
        return name

    def frequent(self, name: str) -> DataFrame:
        return self.spark.table(name).where(F.col("n") >= self.min_docs)

    def added(self, keys: DataFrame) -> DataFrame:
        """A batch's counts without settled keys."""
        counted = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        for name in self.settled:
            counted = counted.join(self.frequent(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return counted

    def ingest(self, keys: DataFrame) -> None:
        """``keys``: one row (h1, h2) for each document and key of the batch."""
        self.levels[0].append(self._write(self.added(keys)))
        level = 0
        while len(self.levels[level]) > 1:
            self._compact(level)
            level += 1

    def merged(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Two runs as one."""
        both = left.alias("l").join(right.hint("merge").alias("r"), ["h1", "h2"], "full_outer")
        return both.select("h1", "h2", (F.coalesce("l.n", F.lit(0)) + F.coalesce("r.n", F.lit(0))).alias("n"))

    def _compact(self, level: int) -> None:
        """The level's runs as one of the next; the settled keys of a run that is merged away go along with their counts."""
        runs, self.levels[level] = self.levels[level], []
        name = self._write(self.merged(*[self.spark.table(r) for r in runs]))
        self.settled = [s for s in self.settled if s not in runs] + [name]
        for r in runs:
            self._drop(r)
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, f"{scratch_root(self.spark)}/tidemark/{name}")

    def close(self) -> DataFrame:
        """All frequent keys with their counts so far."""
        runs = [r for level in self.levels for r in level]
        last = self.spark.table(runs[0])
        for r in runs[1:]:
            last = self.merged(last, self.spark.table(r))
        out = materialise(last.where(F.col("n") >= self.min_docs), "frequent")
        for r in runs:
            self._drop(r)
        return out


def line_table(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """(r1, r2, h1, h2, batch): a row for each key of each document."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars))
    out = docs.select(*row_marks(), F.explode_outer(keys).alias("key")).where("key is not null")  # outer: the optimizer would make all keys again to test for none
    return out.select("__tm_r1", "__tm_r2", key_hash(F.col("key")).alias("k")).select("__tm_r1", "__tm_r2", "k.h1", "k.h2", F.pmod("__tm_r2", F.lit(batches)).cast("int").alias("batch"))


def row_marks() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("__tm_r1"), F.xxhash64(F.lit(3), "doc_id", "text").alias("__tm_r2")]


def verdicts(staged: DataFrame, frequent: DataFrame) -> DataFrame:
    """(r1, r2, drop): each document's dropped keys, in about the square root of their number of buckets by h1."""
    found = join_apart(staged.select("__tm_r1", "__tm_r2", "h1", "h2"), frequent, ["h1", "h2"], "n")
    listed = found.groupBy("__tm_r1", "__tm_r2").agg(F.collect_set(F.struct("h1", "h2")).alias("all"))
    n = F.ceil(F.sqrt(F.size("all"))).cast("long")
    bucketed = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda b: F.filter("all", lambda k: F.pmod(k["h1"], n) == b))
    return listed.select("__tm_r1", "__tm_r2", bucketed.alias("__tm_drop"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` (columns of these names are replaced)."""
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    staged = materialise(line_table(docs, batches, min_chars), "lines", partition_by="batch")
    runs = LineRuns(docs.sparkSession, min_docs)
    for b in range(batches):
        runs.ingest(staged.where(F.col("batch") == b).select("h1", "h2"))
    tagged = docs.select("*", *row_marks()).join(verdicts(staged, runs.close()), ["__tm_r1", "__tm_r2"], "left")
    lines = lines_of(F.col("text"))
    dropped = lambda k: F.array_contains(F.get("__tm_drop", F.pmod(k["h1"], F.size("__tm_drop")).cast("int")), k)
    keep = F.filter(lines, lambda line: (F.length(line_key(line)) < min_chars) | ~dropped(key_hash(line_key(line))))
    kept = F.when(F.col("__tm_drop").isNull(), lines).otherwise(keep)
    out = tagged.withColumn("__tm_kept", kept).withColumn("n_lines", F.size(lines).cast("long"))
    return out.select(*docs.columns, F.array_join("__tm_kept", "\n").alias("kept_text"), "n_lines", (F.col("n_lines") - F.size("__tm_kept")).cast("long").alias("n_dropped"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM f)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM f)), '')) AS kept_sha256
FROM k GROUP BY r, doc_id
"""

"""Groups spelling variants: words one edit apart, found by their rarest positional bigrams.

Runs of letters are counted over all texts. Bigrams of the counted words are ordered by frequency, rarest first, ties by
code points; there are at most (26 + 64)^2 = 8,100 of them, as words have no other letters, so the order goes to the tasks
as a whole. One edit destroys at most two of a word's bigrams, so of two words one edit apart one has, among the three
rarest of its own, a bigram that the other has too, untouched, among its three rarest. An untouched bigram lies wholly
before or wholly behind the edit: its position from the start, or the one from the end, is the same in both words, and so
is all that lies on its unedited side. Of a bigram's repeats the first one lies before the edit if any does, the last one
behind it if any does: these two stand for all. The join keys of a word are therefore, for each of its rarest bigrams and
both sides, the bigram, its position from that side, and the letters from that side up to it; the other side is halved, as
the edit leaves one half alone, and this half joins the key, for either length that the shorter of the two words can have.
Words that share a key are verified by edit distance inside the join, so only true links leave it.

A word's form is its near word of largest count, ties to the smallest in code points, if its count is at least ``DOMINANCE``
times the word's; the root follows forms to the last one. Counts grow tenfold at each step, so there are at most 19 steps,
followed by doubling.

Special rows: a null or empty text has no words; a null doc_id counts as the empty text in the hash that picks typing slips;
repeated rows count as often as they occur; a run of any length is one word, a text of any length is read whole; an empty
table, or one without repeated words, gives an empty result. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, materialise, table

MIN_CHARS, MIN_COUNT, DOMINANCE, SLIP = 7, 2, 10, 31
RAREST = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, less one code point where ``SLIP`` divides its hash."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: counted over all texts."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{min_chars},}}"), F.lit(0))
    runs = docs.select("doc_id", F.explode(found).alias("run"))
    words = runs.select(slipped(F.col("doc_id"), F.col("run")).alias("word")).where(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Place of each bigram, rarest first."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    counts = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 8,100 rows
    return {r["gram"]: i for i, r in enumerate(sorted(counts, key=lambda r: (r["n"], r["gram"])))}


def join_keys(word: str, order: dict[str, int]) -> set[tuple[int, int]]:
    """(length of the shorter word, key) of a word."""
    n = len(word)
    first, last = {}, {}
    for i in range(n - 1):
        place = order[word[i : i + 2]]
        first.setdefault(place, i)
        last[place] = i
    rare = set(heapq.nsmallest(RAREST, (order[word[i : i + 2]] for i in range(n - 1))))
    out = set()
    for place in rare:
        for side, letters, at in (("<", word, first[place]), (">", word[::-1], n - 2 - last[place])):
            for short in (n, n - 1):
                if at + 2 <= short:
                    half = (short + at + 2) // 2
                    out.add((short, f"{short}{side}{at}:{letters[:half]}"))
                    out.add((short, f"{short}{side}{at}|{letters[: at + 2]} {letters[n - short + half :]}"))
    return {(short, xxhash.xxh3_64_intdigest(key) - (1 << 63)) for short, key in out}


def keyed(order) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shorts, keys = [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                for short, key in join_keys(word, order.value):
                    at.append(i)
                    shorts.append(short)
                    keys.append(key)
            words, counts = (c.take(pa.array(at, pa.int64())) for c in batch.columns)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(shorts, pa.int32()), words, counts], ["key", "short", "word", "n"])

    return run


def links(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every pair of words one edit apart, in both directions. ``words``: a written table of word, n."""
    spark = words.sparkSession
    arrow_batches(spark)
    order = spark.sparkContext.broadcast(bigram_order(words))
    keys = materialise(words.select("word", "n").mapInArrow(keyed(order), "key long, short int, word string, n long"), "spelling-keys")
    a, b = keys.alias("a"), keys.alias("b")
    length = lambda c: F.char_length(c)
    # Both sides ask for the same columns, so that they read one exchange.
    near = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.short") == F.col("b.short"))
        & (F.col("a.word") < F.col("b.word"))
        & (F.least(length("a.word"), length("b.word")) == F.col("a.short"))
        & (F.abs(length("a.word") - length("b.word")) <= 1)
        & (F.levenshtein("a.word", "b.word", 1) == 1)
    )
    pairs = a.join(b, near).select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")).distinct()
    pairs = materialise(pairs, "spelling-links")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def with_roots(words: DataFrame) -> DataFrame:
    """Adds ``root`` to a written table of word, n, form."""
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, DOMINANCE)))
    hops = words.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        there = hops.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        hops = materialise(hops.join(there, "root", "left").select("word", F.coalesce("__next", "root").alias("root")), "spelling-roots", compact=True)
    return words.join(hops, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word."""
    words = materialise(vocabulary(docs, min_chars, min_count), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("__best")
    near = links(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rules = -F.col("__best.minus") >= DOMINANCE * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(rules, F.col("__best.near")).alias("form"), F.when(rules, -F.col("__best.minus")).alias("form_n"),
    )
    return with_roots(materialise(found, "spelling-forms")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))

"""Substring dedup: every word covered by a 50-word window that also starts in a document with a smaller id goes.

1. Prefilter. Every window is counted under its anchor, the smallest hash among the 10-word runs inside it; equal
   windows have equal anchors, so the number of documents with an anchor is never below the number of documents with a
   window counted under it. Each partition makes a two-row count-min sketch of its documents' anchors (counts stop at
   two); sketches travel as sorted cell lists and are merged segment by segment. A row has 16 to 32 cells for each anchor,
   whatever the input, so about one in a hundred windows passes falsely at every size; the merged sketch is a written
   table of the cells counted twice or more, and anchors are looked up in it by joins on their cells. Nothing of it is
   broadcast or collected; what reaches the driver is the number of anchors.
2. Exact pass. Windows whose anchor is estimated repeated are grouped by a 96-bit hash of their word sequence (map-side
   combined: the smallest and largest doc_id); those found in several documents go back to the documents after the first.
3. Each document drops the words of its windows among those (by hash, recomputed from the text).

Texts with equal words are represented by the smallest doc_id in the exact pass; the others lose what the rule says
through the representative (the sketch counts them all). Windows and groups of copies that are hot are joined apart from
the others. Null text has no words; a null doc_id counts as larger than all others; rows with equal doc_id do not remove
each other's words; repeated rows lose the same words; texts under 50 words stay as they are; an empty table gives an
empty result. Jobs run while the result is being built. A very long text takes some 60 bytes of memory for each byte.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, join_apart, materialise, table
from tidemark.llm.wordtable import WORD_POWERS_2, Words, chunks, joined, mix64

WINDOW, ANCHOR = 50, 10
SEGMENT, LOAD, PART = 1 << 20, 16, 1 << 22
LAST = 2**63 - 1
U = np.uint64


def window_anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, anchor) of every window."""
    n = len(words.start)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at, grams = words.grams(anchor)
    low = np.full(n, ~U(0), U)
    low[at] = grams
    span, have = window - anchor + 1, 1
    while have < span:  # minimum over the next ``have`` runs, doubled each time
        step = min(have, span - have)
        low[: n - step] = np.minimum(low[: n - step], low[step:])
        have += step
    at = np.flatnonzero(words.text[: n - window + 1] == words.text[window - 1 :])
    return at, low[at]


def cells_of(anchors: np.ndarray, cells: int) -> np.ndarray:
    """A row of the sketch for each of two hashes; row 1's cells follow row 0's."""
    mask = U(cells - 1)
    return np.concatenate([mix64(anchors) & mask, (mix64(anchors ^ U(0x5851F42D4C957F2D)) & mask) + U(cells)])


def per_document(words: Words, at: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, bounds): each document's distinct anchors."""
    order = np.lexsort((anchors, words.text[at]))
    a, d = anchors[order], words.text[at][order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    return a[first], np.searchsorted(d[first], np.arange(words.n + 1))


def describe(window: int, anchor: int) -> Callable:
    """A fingerprint of each row's word sequence, its number of words, and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in chunks(batch):
                marks = [hashlib.blake2b(b, digest_size=16).digest() for b in joined(words, np.ones(len(words.start), bool))]
                anchors, bounds = per_document(words, *window_anchors(words, window, anchor))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(anchors.view(np.int64)))
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array([m[:8] for m in marks], pa.binary()), pa.array([m[8:] for m in marks], pa.binary()), lists], ["row", "doc", "f1", "f2", "anchors"])

    return run


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a list column."""
    bounds = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[bounds[0] : bounds[-1]], bounds - bounds[0]


def packed(found: list[np.ndarray], cells: int, segment: int) -> Iterator[pa.RecordBatch]:
    """A sketch of some anchors: for each segment its cells, each with whether it was met again."""
    cell, n = np.unique(cells_of(np.concatenate(found), cells), return_counts=True)
    part = (cell // U(segment)).astype(np.int64)
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(cell)]):
        inside = (cell[lo:hi] % U(segment)).astype(np.uint32) * np.uint32(2) + (n[lo:hi] > 1).astype(np.uint32)
        blob = zlib.compress(np.diff(inside, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)
        yield pa.record_batch([pa.array([int(part[lo])], pa.int64()), pa.array([blob], pa.binary())], ["segment", "cells"])


def sketch_partition(cells: int, segment: int) -> Callable:
    """The sketch of a partition, in parts of about ``PART`` anchors each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            found.append(flat(batch.column(0))[0].view(U))
            if sum(map(len, found)) > PART:
                yield from packed(found, cells, segment)
                found = []
        if sum(map(len, found)):
            yield from packed(found, cells, segment)

    return run


def merge_segment(segment: int) -> Callable:
    """Adds up one segment of all partitions' sketches, a few at a time, and keeps the cells counted twice or more."""

    def run(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(segment, bool), np.zeros(segment, bool)
        for part in parts:
            for blob in part["cells"]:
                x = np.cumsum(np.frombuffer(zlib.decompress(blob), "<u4"), dtype=np.uint32)
                cell = x >> np.uint32(1)
                twice[cell] |= once[cell] | (x & np.uint32(1)).astype(bool)
                once[cell] = True
        yield pd.DataFrame({"cell": np.flatnonzero(twice) + key[0] * segment})

    return run


def lookups(cells: int) -> Callable:
    """The cells of a batch's anchors, each pair once: with the row that holds it, or in ``more`` the rows if several do. So a passage that many documents share is a record for each batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, bounds = flat(batch.column(2))
            cell = cells_of(anchors.view(U), cells).view(np.int64)
            c0, c1, at = cell[: len(anchors)], cell[len(anchors) :], np.repeat(np.arange(len(batch)), np.diff(bounds))
            order = np.lexsort((at, c1, c0))
            c0, c1, at = c0[order], c1[order], at[order]
            new = np.ones(len(at), bool)
            new[1:] = (c0[1:] != c0[:-1]) | (c1[1:] != c1[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(at)))
            row, doc = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            several = np.repeat(size > 1, size)
            ends = np.concatenate([[0], np.cumsum(np.where(size > 1, size, 0))]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(row[at[several]]), pa.array(doc[at[several]])], ["row", "doc"])
            more = pa.ListArray.from_arrays(pa.array(ends), pairs, mask=pa.array(size == 1)) if len(size) else pa.array([], pa.list_(pairs.type))
            yield pa.record_batch([pa.array(row[at[first]]), pa.array(doc[at[first]]), pa.array(c0[first]), pa.array(c1[first]), more], ["row", "doc", "c0", "c1", "more"])

    return run


def estimated_repeated(marks: DataFrame) -> tuple[DataFrame, int]:
    """(row, doc, cells: the first cells of its anchors counted twice or more in both rows of the sketch), and the cells of a row."""
    anchors = marks.agg(F.sum(F.size("anchors"))).first()[0] or 0
    cells = max(SEGMENT, 1 << (LOAD * anchors - 1).bit_length())
    segment = min(SEGMENT << 4, max(SEGMENT, cells >> 12))
    parts = marks.select("anchors").mapInArrow(sketch_partition(cells, segment), "segment long, cells binary")
    often = materialise(parts.groupBy("segment").applyInPandas(merge_segment(segment), "cell long"), "sketch")
    asked = marks.select("row", "doc", "anchors").mapInArrow(lookups(cells), "row long, doc long, c0 long, c1 long, more array<struct<row:long,doc:long>>")
    hit = asked.join(often.where(F.col("cell") < cells).select(F.col("cell").alias("c0")), "c0", "left_semi")
    hit = hit.join(often.where(F.col("cell") >= cells).select(F.col("cell").alias("c1")), "c1", "left_semi")
    each = hit.select("c0", F.explode(F.coalesce("more", F.array(F.struct("row", "doc")))).alias("r"))
    return each.groupBy("r.row", "r.doc").agg(F.collect_set("c0").alias("cells")), cells


def candidates(cells: int, window: int, anchor: int) -> Callable:
    """(row, doc, cells, text) -> the windows under those cells, each once for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in chunks(batch):
                at, anchors = window_anchors(words, window, anchor)
                if not len(at):
                    continue
                cell = cells_of(anchors, cells)[: len(at)].view(np.int64)
                values, bounds = flat(rows.column(2))
                edges = np.searchsorted(at, words.first)
                hit = np.concatenate([lo + np.flatnonzero(np.isin(cell[lo:hi], values[a:b])) for lo, hi, a, b in zip(edges[:-1], edges[1:], bounds[:-1], bounds[1:])])
                if not len(hit):
                    continue
                starts, h1 = words.grams(window)
                _, h2 = words.grams(window, WORD_POWERS_2)
                at = at[hit]
                where = np.searchsorted(starts, at)
                order = np.lexsort((h1[where], words.text[at]))  # a window once for each document
                where, at = where[order], at[order]
                new = np.ones(len(at), bool)
                new[1:] = (h1[where[1:]] != h1[where[:-1]]) | (words.text[at[1:]] != words.text[at[:-1]])
                where, text = where[new], words.text[at[new]]
                yield pa.record_batch([pa.array(np.asarray(rows.column(0))[text]), pa.array(np.asarray(rows.column(1))[text]), pa.array(h1[where].view(np.int64)), pa.array((h2[where] >> U(32)).astype(np.int64).astype(np.int32))], ["row", "doc", "h1", "h2"])

    return run


def remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in chunks(batch):
                drop = np.zeros(len(words.start), bool)
                lists = rows.column(rows.schema.get_field_index("_gone"))
                whole = np.asarray(rows.column(rows.schema.get_field_index("_copy")).fill_null(False))
                offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
                sized = np.diff(offsets) * np.asarray(lists.is_valid())
                if sized.any():
                    at, h1 = words.grams(window)
                    h1 = h1.view(np.int64)
                    edges = np.searchsorted(at, words.first)
                    hit = [lo + np.flatnonzero(np.isin(h1[lo:hi], values[offsets[d] : offsets[d + 1]])) for d in np.flatnonzero(sized) if (hi := edges[d + 1]) > (lo := edges[d])]
                    if hit:
                        drop = words.covered(at[np.concatenate(hit)], window)
                drop |= (whole & (words.counts >= window))[words.text]
                removed = np.bincount(words.text[drop], minlength=words.n)
                kept = [b.decode("utf-8", "replace") for b in joined(words, ~drop)]
                yield pa.record_batch([*[rows.column(i) for i, c in enumerate(rows.schema.names) if c not in ("text", "_gone", "_copy")], pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*[c for c in rows.schema.names if c not in ("text", "_gone", "_copy")], "n_words", "n_removed", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the kept words joined by one space)."""
    arrow_batches(docs.sparkSession)
    # A row is known by its id and a hash of its text: two documents are never taken for one.
    docs = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "doc_id", "text")
    marks = materialise(docs.select("row", "doc", "text").mapInArrow(describe(window, anchor), "row long, doc long, f1 binary, f2 binary, anchors array<long>"), "marks")
    firsts = materialise(marks.groupBy("f1", "f2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "firsts")
    copies = join_apart(marks.select("row", "doc", "f1", "f2"), firsts, ["f1", "f2"], "n").where(F.col("doc") > F.col("rep")).select("row", "doc").distinct()
    copies = materialise(copies.withColumn("_copy", F.lit(True)), "copies")
    passing, cells = estimated_repeated(marks)  # copies count too: that overestimates, and spares a join before it
    passing = materialise(passing.join(copies, ["row", "doc"], "left_anti"), "passing")
    texts = docs.join(passing, ["row", "doc"]).select("row", "doc", "cells", "text")
    found = materialise(texts.mapInArrow(candidates(cells, window, anchor), "row long, doc long, h1 long, h2 int"), "windows")
    repeated = found.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").select("h1", "h2", "least", "n")
    repeated = materialise(repeated, "repeated")
    gone = join_apart(found, repeated, ["h1", "h2"], "n").where(F.col("doc") > F.col("least")).groupBy("row", "doc").agg(F.collect_set("h1").alias("_gone"))
    verdict = gone.join(copies, ["row", "doc"], "full_outer")
    ready = docs.join(verdict, ["row", "doc"], "left").select("doc_id", "text", "_gone", "_copy")
    return ready.mapInArrow(remove(window), "doc_id long, n_words long, n_removed long, kept_text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM d WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
g AS (SELECT doc_id, i FROM h JOIN m USING (h) WHERE doc_id > least),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM g),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
k AS (SELECT p.doc_id, p.pos, word, c.pos IS NOT NULL AS gone FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos),
a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""

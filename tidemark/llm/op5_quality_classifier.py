"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated output.

Tokens are runs of letters (hashed into ``BUCKETS``), digits (one token), single other characters, and after each word
a token of its shape (case, and whether it repeats the word before). Random indexing gives every token a fixed sparse
+-1 index vector; a token's word vector is the sum of the index vectors of its neighbours over the whole corpus. Each
partition adds up integers in one array of fixed size; arrays are merged by bucket range, in steps that take some hundred
at a time however many partitions there are, so sums are exact and reruns agree. The finished table (BUCKETS x DIMS floats, a fixed 4 MB) is shipped to all tasks.

A document is the plain mean of its shape and character vectors beside the frequency-damped mean of its word vectors.
The network is fitted on at most ``SAMPLE_ROWS`` labelled documents (the first in a hash order) that are not held out
(crc32 of the id mod 4 is not 2), one text for each id and label where ids repeat; a fifth of them is kept from the weights and sets the temperature of the output.

Null and empty texts score as a document of no tokens. Without labels of both kinds every score is the share of good
labels, or 0.5 without any. Null ids are not held out. Repeated rows score alike. Texts are read whole whatever their
length; an empty table gives an empty result; columns beside doc_id, text and quality are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, table
from tidemark.llm.wordtable import BYTE_POWERS, BYTE_VALUE, U, Words, chunks, mix64, prefix

BUCKETS, RESERVED, DIMS, NONZEROS, REACH = 16384, 128, 64, 4, 2
SEGMENTS = 16
#: Above so many arrays a bucket range is merged in three steps.
MERGED = 64
DAMPING = 1e-3
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
SAMPLE_ROWS = 8000
CUT = 0.7

_RNG = np.random.Generator(np.random.PCG64(11))
PLACE = _RNG.integers(0, DIMS, (BUCKETS, NONZEROS))
SIGN = _RNG.choice([-1.0, 1.0], (BUCKETS, NONZEROS))
_KIND = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 other
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2


def token_stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(token, text) of a chunk, in order, shapes after their words."""
    data, bounds = words.data, words.bounds
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    opens = kind > 0
    opens[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    opens[inner] = kind[inner] > 0
    start = np.flatnonzero(opens)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    what = kind[start]
    change = np.flatnonzero(np.concatenate([kind[1:] != kind[:-1], [True]])) + 1
    end = np.minimum(change[np.searchsorted(change, start, "right")], np.append(start[1:], len(data)))
    text = np.searchsorted(bounds, start, "right") - 1
    up, down = BYTE_POWERS.get(len(data) + 1)
    sums = prefix(BYTE_VALUE[data] * up[: len(data)])
    value = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(U))
    letters = what == 1
    token = np.where(letters, RESERVED + (value % U(BUCKETS - RESERVED)).astype(np.int64), np.where(what == 2, 1, np.minimum(data[start].astype(np.int64), 96)))
    capital = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    n_capital, size = capital[end] - capital[start], end - start
    case = np.where(n_capital == 0, 0, np.where(n_capital * 2 > size, 2, 1))
    at = np.flatnonzero(letters)
    again = np.zeros(len(start), bool)
    again[at[1:]] = (value[at[1:]] == value[at[:-1]]) & (text[at[1:]] == text[at[:-1]])
    shape = np.where(letters, 100 + case + 3 * again, -1)
    both = np.stack([token, shape], 1).ravel()
    keep = both >= 0
    return both[keep], np.repeat(text, 2)[keep]


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's sums: for each bucket its neighbours' index vectors, and its count."""
    sums, counts = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS)
    for batch in batches:
        for _, words in chunks(batch):
            token, text = token_stream(words)
            counts += np.bincount(token, minlength=BUCKETS)
            for reach in range(1, REACH + 1):
                near = text[reach:] == text[:-reach]
                left, right = token[:-reach][near], token[reach:][near]
                for a, b in ((left, right), (right, left)):
                    for s in range(NONZEROS):
                        sums += np.bincount(a * DIMS + PLACE[b, s], SIGN[b, s], BUCKETS * DIMS)
    full = np.concatenate([sums.reshape(BUCKETS, DIMS), counts[:, None]], 1)
    if counts.any():
        blobs = [zlib.compress(part.astype("<f8").tobytes(), 1) for part in np.split(full, SEGMENTS)]
        part = TaskContext.get().partitionId()
        yield pa.record_batch([pa.array(range(SEGMENTS), pa.int32()), pa.array([part] * SEGMENTS, pa.int32()), pa.array(blobs, pa.binary())], ["segment", "part", "sums"])


def merge(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = 0
    for part in parts:
        for blob in part["sums"]:
            total = total + np.frombuffer(zlib.decompress(blob), "<f8")
    yield pd.DataFrame({"segment": [key[0]], "part": [key[1]], "sums": [zlib.compress(total.tobytes(), 1)]})


def word_vectors(texts: DataFrame) -> np.ndarray:
    """(BUCKETS, DIMS) unit vectors, those of words damped by frequency."""
    shape = "segment int, part int, sums binary"
    merged = texts.select("text").mapInArrow(contexts, shape)
    most = 2 * texts.sparkSession.sparkContext.defaultParallelism
    for groups in (most, math.isqrt(most), 1) if most > MERGED else (1,):
        merged = merged.withColumn("part", F.col("part") % groups).groupBy("segment", "part").applyInPandas(merge, shape)
    full = np.zeros((SEGMENTS, BUCKETS // SEGMENTS, DIMS + 1))
    for r in merged.toLocalIterator():
        full[r["segment"]] = np.frombuffer(zlib.decompress(r["sums"]), "<f8").reshape(-1, DIMS + 1)
    full = full.reshape(BUCKETS, DIMS + 1)
    vectors, counts = full[:, :DIMS], full[:, DIMS]
    vectors = vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    share = counts[RESERVED:] / max(1.0, counts[RESERVED:].sum())
    vectors[RESERVED:] *= (DAMPING / (DAMPING + share))[:, None]
    return vectors.astype(np.float32)


def pool(words: Words, vectors: np.ndarray) -> np.ndarray:
    """(texts, 2 * DIMS): mean of shapes and characters, mean of words."""
    token, text = token_stream(words)
    out = np.zeros((words.n, 2 * DIMS), np.float32)
    for half, mine in enumerate((token < RESERVED, token >= RESERVED)):
        t, d = token[mine], text[mine]
        if len(t):
            first = np.flatnonzero(np.diff(d, prepend=-1))
            sums = np.add.reduceat(vectors[t], first, axis=0)
            out[d[first], half * DIMS : (half + 1) * DIMS] = sums / np.diff(np.append(first, len(t)))[:, None]
    return out


def pooled_sample(vectors) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in chunks(batch):
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array([x.tobytes() for x in pool(words, vectors.value)], pa.binary())], ["doc_id", "quality", "x"])

    return run


class Network:
    """Standardised inputs, one hidden layer, a logistic output divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        order = rng.permutation(len(x))
        held, fit = order[: len(x) // 5], order[len(x) // 5 :]
        z = self._standard(x)
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        step = 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
                step += 1
                h = np.tanh(z[at] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[at]) / len(at)
                back = np.outer(e, p[2]) * (1 - h * h)
                for i, g in enumerate((z[at].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ e + DECAY * p[2], e.sum(keepdims=True))):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    p[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if len(held):
            logits = self.logits(x[held])
            grid = np.geomspace(0.25, 8, 61)
            self.temperature = float(min(grid, key=lambda t: np.logaddexp(0, np.where(y[held] > 0, -logits, logits) / t).mean()))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.p
        return np.tanh(self._standard(x) @ p[0] + p[1]) @ p[2] + p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))


class Constant:
    def __init__(self, value: float) -> None:
        self.value = value

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, vectors, sample_rows: int = SAMPLE_ROWS):
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    # One text for each chosen doc_id and label, the first in hash order of those that repeat: never more rows than were chosen.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = texts.select("doc_id", "quality", "text").mapInArrow(pooled_sample(vectors), "doc_id long, quality int, x binary").collect()
    rows = sorted((r["doc_id"], r["quality"], bytes(r["x"])) for r in rows)
    if len({q for _, q, _ in rows}) < 2:
        return Constant(float(np.mean([q for _, q, _ in rows])) if rows else 0.5)
    return Network(np.stack([np.frombuffer(b, np.float32) for *_, b in rows]).astype(float), np.array([q for _, q, _ in rows], float))


def scored(vectors, model, cut: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in chunks(batch):
                score = model.scores(pool(words, vectors.value))
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    arrow_batches(spark)
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    model = fit(docs, labels, vectors)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(scored(vectors, model, cut), "doc_id long, held_out boolean, score double, predicted int")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

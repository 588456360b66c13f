"""Quality rules by line sequence labelling: a linear-chain conditional random field marks lines content or boilerplate.

Each line with a word gets a few features (symbols, exclamation marks, upper case, repeated words, pipes, licence
words, length, ending). The field has one weight for each feature (of boilerplate against content) and a 2 x 2
table of transitions; Viterbi decoding gives the labels, and a document is kept if content lines hold at least
``MIN_CONTENT`` of its words and the base rule holds.

The field is trained on a bounded sample of labelled documents (``SAMPLE_ROWS`` rows of ``labels``, the first in the
order of a hash). The labels are of documents, those of lines are hidden: expectation-maximisation by best paths starts
with boilerplate in all lines of bad documents, fits the field, labels the bad documents' lines anew by Viterbi under it
(at least one of a document stays boilerplate; lines of good documents are content), and goes on in rounds until no line
changes its label. Feature extraction for the sample runs on the executors while the result is being built; the driver
gets numbers. Without labels of both kinds, ``DEFAULT`` weights hold.

Null and empty texts have no words and fail the base rule. Lines without a word are no part of the sequence. Of rows
that share a doc_id one text (the first by hash) serves for training; each is judged by its own text, equal texts alike.
Equal path scores go to content. An empty table gives an empty result; long texts are judged whole, in memory of some
hundred bytes for each of their words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, table
from tidemark.llm.wordtable import BYTE_POWERS, BYTE_VALUE, U, Words, buffers, chunks, mix64, prefix

MIN_CONTENT = 0.5
SAMPLE_ROWS = 2000
TRAIN_STEPS, MORE_STEPS, TRAIN_LINES, ROUNDS = 150, 50, 64, 4
# The symbols of the base rule, and words that licence lines are made of.
SYMBOLS = b"#*$%&|<>"
LICENCE_WORDS = ["Licensed", "licensed", "License,", "License.", "Released", "License", "rights", "reserved.", "Copyright", "copyright", "CC"]
FEATURES = ["bias", "symbols", "bangs", "upper", "repeats", "pipes", "licence", "short", "unfinished", "digits"]
FIGURES = ["doc_id long", "n_words long", "word_chars long", "n_symbols long", "n_dup_lines long", "n_repeat_words long", "base_failed boolean", "kept boolean", "n_lines long", "n_boilerplate long", "content_share double"]
#: Weights without training: bias, then the features in order; transitions keep a label.
DEFAULT = (np.array([-3.0, 20.0, 6.0, 2.0, 6.0, 8.0, 5.0, 0.0, 0.3, 0.0]), np.array([[0.5, -0.5], [-0.5, 0.5]]))

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def hashes_of(strings: list[str]) -> np.ndarray:
    data, bounds = buffers(pa.array([" ".join(strings)]))
    return Words(data, bounds).hash


LICENCE = np.sort(hashes_of(LICENCE_WORDS))


def counted(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[hi] - sums[lo]


def repeated(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its value occurs twice or more with its owner, and whether it did so before."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    o, v = owner[order], values[order]
    same = np.zeros(len(v), bool)
    same[1:] = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    often, later = np.zeros(len(v), bool), np.zeros(len(v), bool)
    often[order], later[order] = twice, same
    return often, later


class Lines:
    """The lines with a word of a chunk of texts: owner text, words, features; and the base figures of each text."""

    def __init__(self, words: Words) -> None:
        data, bounds, n = words.data, words.bounds, words.n
        newline = np.flatnonzero(data == 10)
        # A text's first line begins where it does; empty texts and lines at a text's end get their owner by order.
        owner = np.concatenate([np.arange(n), np.searchsorted(bounds, newline, "right") - 1])
        order = np.lexsort((owner, np.concatenate([bounds[:-1], newline + 1])))
        start, owner = np.concatenate([bounds[:-1], newline + 1])[order], owner[order]
        stop = np.empty(len(start), np.int64)
        stop[:-1] = start[1:] - 1
        stop[-1:] = len(data)
        last = np.ones(len(start), bool)
        last[:-1] = owner[1:] != owner[:-1]
        stop[last] = bounds[1:][owner[last]]
        w0, w1 = np.searchsorted(words.start, start), np.searchsorted(words.start, stop)
        has = w1 > w0
        self.start, self.stop, self.owner, self.w0, self.w1 = start[has], stop[has], owner[has], w0[has], w1[has]
        self.n_words = self.w1 - self.w0
        self.first = np.searchsorted(self.owner, np.arange(n + 1))
        up, down = BYTE_POWERS.get(len(data) + 1)
        sums = prefix(BYTE_VALUE[data] * up[: len(data)])
        line_hash = mix64((sums[self.stop] - sums[self.start]) * down[self.start] + (self.stop - self.start).astype(U))
        _, later = repeated(self.owner, line_hash)
        at, grams = words.grams(5)
        often, _ = repeated(words.text[at], grams)
        covered = words.covered(at[often], 5)
        inside = np.zeros(len(data), bool)
        lead = (data & 0xC0) != 0x80
        inside[:] = lead & ~((data == 32) | ((data >= 9) & (data <= 13)))
        self.word_chars = counted(inside, bounds[:-1], bounds[1:])
        symbol = _SYMBOL[data]
        self.n_symbols = counted(symbol, bounds[:-1], bounds[1:])
        self.n_dup_lines = np.bincount(self.owner[later], minlength=n)
        self.n_repeat_words = np.bincount(words.text[covered], minlength=n)
        self.counts = words.counts
        self.base_failed = (words.counts < 10) | (100 * self.n_repeat_words > 20 * words.counts)
        self._features(words, inside, symbol)

    def _features(self, words: Words, inside: np.ndarray, symbol: np.ndarray) -> None:
        data, k = words.data, self.n_words
        chars = np.maximum(1, counted(inside, self.start, self.stop))
        letters = counted(_LETTER[data], self.start, self.stop)
        same = np.zeros(len(words.start), bool)
        same[1:] = words.hash[1:] == words.hash[:-1]
        same[self.w0] = False
        final = data[words.end[self.w1 - 1] - 1] if len(k) else data[:0]
        bang = (data[words.end - 1] == 33) & (words.end - words.start > 1)
        licence = np.isin(words.hash, LICENCE)
        pipe = (words.end - words.start == 1) & (data[words.start] == 124)
        self.x = np.stack(
            [
                np.ones(len(k)),
                counted(symbol, self.start, self.stop) / chars,
                counted(bang, self.w0, self.w1) / np.maximum(1, k),
                np.where(letters > 3, counted(_UPPER[data], self.start, self.stop) / np.maximum(1, letters), 0),
                counted(same, self.w0, self.w1) / np.maximum(1, k),
                counted(pipe, self.w0, self.w1) / np.maximum(1, k),
                counted(licence, self.w0, self.w1) > 0,
                k < 4,
                ~np.isin(final, list(b".!?")),
                counted((data >= 48) & (data < 58), self.start, self.stop) / chars,
            ],
            axis=1,
        ) if len(k) else np.zeros((0, len(FEATURES)))


def viterbi(scores: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best labels; scores: of label 1 against label 0 for each line; first: each sequence's range of lines. All sequences step together."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    active = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), "left")  # sequences longer than t
    best = np.zeros((len(order), 2))
    back = np.zeros((len(scores), 2), np.int8)
    for t, m in enumerate(active):
        at = first[:-1][order[:m]] + t
        if t:
            through = best[:m, :, None] + transitions[None]
            back[at] = through.argmax(axis=1)
            best[:m] = through.max(axis=1)
        best[:m, 1] += scores[at]
    labels = np.zeros(len(scores), np.int8)
    state = best.argmax(axis=1).astype(np.int8)
    for t in range(len(active) - 1, -1, -1):
        rows = order[: active[t]]
        at = first[:-1][rows] + t
        labels[at] = state[: active[t]]
        state[: active[t]] = back[at, labels[at]]
    return labels


def stretches(first: np.ndarray) -> list[np.ndarray]:
    """Lines at place 0, 1, ... of all stretches; long texts are cut. Stretches are in order of length, so each entry continues the first ones of the entry before."""
    starts = np.concatenate([np.arange(a, b, TRAIN_LINES) for a, b in zip(first[:-1], first[1:])])
    sizes = np.minimum(TRAIN_LINES, np.repeat(first[1:], -(-np.diff(first) // TRAIN_LINES)) - starts)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    return [starts[: int((sizes > i).sum())] + i for i in range(int(sizes[0]))]


def likelihood(w: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, at: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """Log-likelihood of labels y by a line, and its gradient by w and t, by the forward-backward recursions."""
    e = x @ w
    f, z = [], np.zeros(len(at[0]))
    for i, now_at in enumerate(at):
        n = len(now_at)
        now = np.zeros((n, 2))
        if i:
            now[:, 0] = np.logaddexp(f[-1][:n, 0] + t[0, 0], f[-1][:n, 1] + t[1, 0])
            now[:, 1] = np.logaddexp(f[-1][:n, 0] + t[0, 1], f[-1][:n, 1] + t[1, 1])
        now[:, 1] += e[now_at]
        z[:n] = np.logaddexp(now[:, 0], now[:, 1])
        f.append(now)
    p, seen, expected, back = np.zeros(len(x)), np.zeros((2, 2)), np.zeros((2, 2)), np.zeros((len(at[0]), 2))
    for i in range(len(at) - 1, -1, -1):
        n = len(at[i])
        p[at[i]] = np.exp(f[i][:, 1] + back[:n, 1] - z[:n])
        if i:
            np.add.at(seen, (y[at[i] - 1].astype(int), y[at[i]].astype(int)), 1)
            ahead = [back[:n, 0], back[:n, 1] + e[at[i]]]
            for j in (0, 1):
                for k in (0, 1):
                    expected[j, k] += np.exp(f[i - 1][:n, j] + t[j, k] + ahead[k] - z[:n]).sum()
            back[:n] = np.stack([np.logaddexp(t[j, 0] + ahead[0], t[j, 1] + ahead[1]) for j in (0, 1)], 1)
    value = (y @ e + (seen * t).sum() - z.sum()) / len(x)
    return float(value), np.concatenate([x.T @ (y - p), (seen - expected).ravel()]) / len(x)


def train(x: np.ndarray, y: np.ndarray, first: np.ndarray, steps: int = TRAIN_STEPS, start: tuple[np.ndarray, np.ndarray] = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with a small ridge, by Adam."""
    at = stretches(first)
    w, t = start
    m = v = np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        g = likelihood(w, t, x, y, at)[1] - 1e-4 * np.concatenate([w, t.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        delta = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, t = w + delta[: len(w)], t + delta[len(w) :].reshape(2, 2)
    return w, t


def learn(x: np.ndarray, good: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The field from documents' labels alone. good: of each document."""
    bad = np.repeat(~good, np.diff(first))
    y = bad.astype(float)
    w, t = DEFAULT
    for k in range(rounds):
        w, t = train(x, y, first, MORE_STEPS if k else TRAIN_STEPS, (w, t))
        e = x @ w
        before, y = y, viterbi(e, t, first) * bad.astype(float)
        for d in np.flatnonzero(~good & (np.diff(first) > 0)):
            lines = slice(first[d], first[d + 1])
            if not y[lines].any():
                y[first[d] + e[lines].argmax()] = 1
        if (y == before).all():
            break
    return w, t


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, words in chunks(batch):
            lines = Lines(words)
            blobs = [lines.x[a:b].astype("<f4").tobytes() for a, b in zip(lines.first[:-1], lines.first[1:])]
            yield pa.record_batch([rows.column(rows.schema.get_field_index("quality")), pa.array(blobs, pa.binary())], ["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    arrow_batches(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    # One text for each chosen doc_id and label, the first in hash order of those that repeat: never more rows than were chosen.
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = texts.select("quality", "text").mapInArrow(sample_features, "quality int, x binary").collect()
    rows = sorted((r["quality"], bytes(r["x"])) for r in rows if len(r["x"]))
    if len({q for q, _ in rows}) < 2:
        return DEFAULT
    xs = [np.frombuffer(b, "<f4").reshape(-1, len(FEATURES)).astype(float) for _, b in rows]
    return learn(np.concatenate(xs), np.array([q == 1 for q, _ in rows]), np.concatenate([[0], np.cumsum([len(x) for x in xs])]))


def judge(words: Words, weights: tuple[np.ndarray, np.ndarray], min_content: float) -> tuple[Lines, np.ndarray, np.ndarray, np.ndarray]:
    """(lines, labels, content share, kept) of a chunk."""
    lines = Lines(words)
    labels = viterbi(lines.x @ weights[0], weights[1], lines.first)
    content = np.bincount(lines.owner[labels == 0], lines.n_words[labels == 0], words.n)
    share = content / np.maximum(1, words.counts)
    return lines, labels, share, ~lines.base_failed & (share >= min_content)


def measured(weights, min_content: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in chunks(batch):
                lines, labels, share, kept = judge(words, weights, min_content)
                boiler = np.bincount(lines.owner[labels == 1], minlength=words.n)
                figures = [pa.array(f, pa.int64()) for f in (words.counts, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words, np.diff(lines.first), boiler)]
                yield pa.record_batch([rows.column(0), *figures[:5], pa.array(lines.base_failed), pa.array(kept), *figures[5:], pa.array(share)], [c.split()[0] for c in FIGURES])

    return run


def filtered(weights, min_content: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in chunks(batch):
                yield rows.filter(pa.array(judge(words, weights, min_content)[3]))

    return run


def quality_figures(docs: DataFrame, labels: DataFrame, min_content: float = MIN_CONTENT) -> DataFrame:
    weights = fit(docs, labels)
    return docs.select("doc_id", "text").mapInArrow(measured(weights, min_content), ", ".join(FIGURES))


def good_documents(docs: DataFrame, labels: DataFrame, min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns."""
    weights = fit(docs, labels)
    return docs.mapInArrow(filtered(weights, min_content), docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_figures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

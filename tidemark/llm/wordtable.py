"""Words of a batch of texts as numpy arrays, read straight from Arrow's UTF-8 buffer: no Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are polynomials modulo 2**64 over random byte values,
so the hash of any range is a difference of prefix sums, and are mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
CHUNK_BYTES = 2 << 20


class Powers:
    """Powers of an odd base and of its inverse, as long as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, x in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, x, U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


BYTE_POWERS = Powers(0x9E3779B97F4A7C15)
WORD_POWERS = Powers(0xC2B2AE3D27D4EB4F)
WORD_POWERS_2 = Powers(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=out[1:])
    return out


class Words:
    """Words of consecutive texts. start, end: byte ranges in ``data``; first[d]:first[d + 1]: words of text d."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.data, self.bounds, self.n = data, bounds, len(bounds) - 1
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = ~SPACE[data]
        opens = word[1:-1] & ~word[:-2]
        closes = word[1:-1] & ~word[2:]
        inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
        opens[inner] = word[1:-1][inner]
        closes[inner - 1] = word[1:-1][inner - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(self.n), self.counts)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            up, down = BYTE_POWERS.get(len(self.data) + 1)
            sums = prefix(BYTE_VALUE[self.data] * up[: len(self.data)])
            self._hash = mix64((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U))
        return self._hash

    def grams(self, k: int, powers: Powers = WORD_POWERS) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words within a text."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        up, down = powers.get(n + 1)
        sums = prefix(self.hash * up[:n])
        at = np.flatnonzero(self.text[: n - k + 1] == self.text[k - 1 :])
        return at, mix64((sums[at + k] - sums[at]) * down[at])

    def covered(self, at: np.ndarray, k: int) -> np.ndarray:
        """Which words lie in one of the runs of k words that begin at ``at``."""
        edge = np.zeros(len(self.start) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, np.asarray(at) + k, -1)
        return np.cumsum(edge[:-1]) > 0


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes of text: what a kernel holds at a time, whatever Spark's batches are (64 MB by default)."""
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of a batch, each with its words."""
    data, bounds = buffers(batch.column(batch.schema.get_field_index(column)))
    for lo, hi in slices(bounds):
        part = bounds[lo : hi + 1]
        yield batch.slice(lo, hi - lo), Words(data[part[0] : part[-1]], part - part[0])


def joined(words: Words, keep: np.ndarray) -> list[bytes]:
    """For each text, its kept words joined by one space."""
    start, end, text = words.start[keep], words.end[keep], words.text[keep]
    size = end - start + 1
    total = int(size.sum())
    out = np.full(total, 0x20, np.uint8)
    to = np.cumsum(size) - size
    step = np.arange(total)
    owner = np.repeat(np.arange(len(size)), size)
    inner = step - to[owner]
    body = inner < (size[owner] - 1)
    out[body] = words.data[(start[owner] + inner)[body]]
    ends = np.zeros(words.n + 1, np.int64)
    np.add.at(ends, text + 1, size)
    ends = np.cumsum(ends)
    blob = out.tobytes()
    return [blob[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1], ends[1:])]

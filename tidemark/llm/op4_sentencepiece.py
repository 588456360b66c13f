"""SentencePiece encoding and decoding on the tokenizers library.

The driver reads the model's protobuf bytes and ships them (the size of one model file). Each worker parses them once,
rebuilds the tokenizer (normaliser, space marker, unigram scores or merges by score, byte fallback) and encodes Arrow
batches with the library's own threads. A model without a character map needs no library normaliser: the marker is
put in while the batch is made, which encodes the same text faster. Decoding looks pieces' bytes up in a table. Every
row's whole text is encoded by the sentencepiece library too and the ids compared (``parity``), and the ids' decoding is
compared with the text (``round_trip``).

Null and empty texts have no ids and decode to the empty text. A text that holds the marker itself comes back with
spaces in its place, as the format has it, and so does one that the model's normaliser changes: its round_trip is false.
Repeated rows are encoded alike, each on its own row; an empty table gives an empty result; long texts go in whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import sentencepiece_model as spm
from tidemark.llm.common import arrow_batches, table
from tidemark.llm.wordtable import buffers, slices

MODEL_PATH = os.environ.get("TIDEMARK_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
THREADS = 2
KEPT = b"\xff"  # a blank of the unknown piece's writing, which is no word's lead; no text holds this byte


class Codec:
    """Encodes and decodes batches by one model."""

    def __init__(self, data: bytes, threads: int = THREADS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = spm.parse(data)
        self.tokenizer = spm.build(self.model)
        self.plain = not self.model.charsmap and not self.model.remove_extra_whitespaces
        if self.plain:
            self.tokenizer.normalizer = None
            self.tokenizer.pre_tokenizer = None
        self.prefix = spm.MARK if self.model.add_dummy_prefix else ""
        table_ = [bytes([int(p[3:5], 16)]) if k == spm.BYTE else b"" if k == spm.CONTROL else self.model.unknown.encode().replace(b" ", KEPT) if k == spm.UNKNOWN else p.replace(spm.MARK, " ").encode() for p, _, k in self.model.pieces]
        self.bytes = np.frombuffer(b"".join(table_), np.uint8)
        self.size = np.array([len(b) for b in table_])
        self.at = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.plain:
            texts = [self.prefix + t.replace(" ", spm.MARK) if t else t for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list) -> list[str]:
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *[np.asarray(x, np.int32) for x in ids]])
        size = self.size[flat]
        total = np.cumsum(size)
        inner = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - size, size)
        out = self.bytes[np.repeat(self.at[flat], size) + inner].tobytes()
        ends = np.concatenate([[0], total])[np.cumsum(counts)] if len(flat) else np.zeros(len(ids), np.int64)
        texts = []
        for lo, hi in zip([0, *ends[:-1]], ends):
            piece = out[lo:hi]
            if self.model.remove_extra_whitespaces:
                piece = piece.lstrip(b" ")
            elif self.prefix and piece[:1] == b" ":
                piece = piece[1:]
            texts.append(piece.replace(KEPT, b" ").decode("utf-8", "replace"))
        return texts


#: What can be asked for of each row.
OUTPUTS = {"n_tokens": "long", "ids_sha256": "string", "ids": "array<int>", "decoded": "string", "round_trip": "boolean", "parity": "boolean"}


def encoded(data, threads: int, outputs: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        codec = Codec(data.value, threads)
        judge = sentencepiece.SentencePieceProcessor(model_proto=data.value)
        for batch in (b.slice(lo, hi - lo) for b in batches for lo, hi in slices(buffers(b.column(b.schema.get_field_index("text")))[1])):
            at = batch.schema.get_field_index("text")
            texts = [t or "" for t in batch.column(at).to_pylist()]
            lists = codec.encode(texts)
            ids = [np.asarray(x, "<i4") for x in lists]
            make = {
                "n_tokens": lambda: pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": lambda: pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                "ids": lambda: pa.array(ids, pa.list_(pa.int32())),
                "decoded": lambda: pa.array(codec.decode(ids), pa.string()),
                "round_trip": lambda: pa.array([a == b for a, b in zip(codec.decode(ids), texts)], pa.bool_()),
                "parity": lambda: pa.array([a == b for a, b in zip(lists, judge.encode(texts, num_threads=threads))], pa.bool_()),
            }
            yield pa.record_batch([*[batch.column(i) for i in range(batch.num_columns) if i != at], *[make[o]() for o in outputs]], [*[c for c in batch.schema.names if c != "text"], *outputs])

    return run


def encode_documents(docs: DataFrame, outputs: list[str] | None = None, model_path: str = MODEL_PATH, threads: int = THREADS) -> DataFrame:
    """doc_id and the asked outputs (all, if none are named). ids_sha256 is of the ids as little-endian 32-bit integers."""
    outputs = list(OUTPUTS) if outputs is None else outputs
    arrow_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    shape = ", ".join(["doc_id long", *[f"{o} {OUTPUTS[o]}" for o in outputs]])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded(data, threads, outputs), shape)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), ["n_tokens", "ids_sha256", "round_trip", "parity"])

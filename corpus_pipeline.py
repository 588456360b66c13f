"""From raw documents to token ids: quality rules, line dedup, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``docs``. ``run`` deletes what a stage wrote on its way as soon as
its result is written, and each result once the next one is.

What each stage makes of special rows, beside what its operator's docstring says: null and empty texts end in the first
stage (fewer than ten words); a text that loses all its lines in the second stays as an empty one, is no near-duplicate
of any other, and is never taken by the mix; rows that repeat are separate documents until the third stage, which keeps
one of them; an empty table passes through all stages as one; columns beside those of documents are kept up to the
fourth stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import forget, materialise, passing, table
from tidemark.llm.op1_jaccard_join import without_near_duplicates
from tidemark.llm.op3_quality_rules import good_documents
from tidemark.llm.op4_sentencepiece import encode_documents
from tidemark.llm.op7_mixing import mixed_documents
from tidemark.llm.op8_line_dedup import dedup_lines


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line labels and the base rule keep."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more share."""
    out = dedup_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return without_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a row each time."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return encode_documents(docs, ["n_tokens", "ids", "round_trip", "parity"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: The first stage is a trained sequence model: no SQL expresses it; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing(spark) as keep:
            keep.append(f"stage-{name}")
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

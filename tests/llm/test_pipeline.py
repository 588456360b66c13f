"""Each stage of the pipeline on its own input, against plain Python."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm_operators import brute_classes, brute_lines, corpus, make, words
from tidemark.llm import op4_sentencepiece as op4

pytestmark = pytest.mark.skipif(not os.path.exists(op4.MODEL_PATH), reason="no model file")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = corpus(seed=3, n=80)
    make(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "sentencepiece":
            assert out.columns == columns
        if name == "quality_rules":
            kept = {r["doc_id"] for r in out.collect()}
            assert kept and all(len(words(t)) >= 10 for i, t, _ in before if i in kept)
        elif name == "line_dedup":
            assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted((i, t) for i, _, _, t in brute_lines(before))
        elif name == "jaccard_join":
            root, _ = brute_classes(before)
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(root.values()))
        elif name == "source_mix":
            total, texts = sum(len(words(t)) for _, t, _ in before), {(i, t) for i, t, _ in before}
            rows = out.collect()
            assert {(r["doc_id"], r["text"]) for r in rows} <= texts  # whole documents
            assert abs(sum(len(words(r["text"])) for r in rows) - 1.5 * total) <= 0.05 * total
        else:
            assert out.where(~F.col("parity") | ~F.col("round_trip")).count() == 0 and out.count() == len(before)
        docs = out


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_run_leaves_nothing_but_its_last_input(spark, sf_dir):
    from tidemark.llm.common import clear_scratch, scratch_root

    clear_scratch(spark)
    rows = corpus_pipeline.run(spark, sf_dir).count()
    left = os.listdir(f"{scratch_root(spark)}/tidemark".removeprefix("file://"))
    assert rows > 0 and len(left) == 1 and left[0].startswith("stage-source_mix-")
    assert spark.read.parquet(f"{sf_dir}/documents.parquet").count() > 0


def test_special_tables(spark, sf_dir, tmp_path):
    """Null columns, repeated rows, clashing names, an empty table: no stage fails, and all columns stay."""
    long = " ".join(f"w{k}" for k in range(300)) + ".\nAnother line of quite ordinary words, ended well.\n"
    rows = [(1, long, "a"), (1, long, "a"), (None, long + "x y z.", None), (2, None, "a"), (3, "", None), (4, long * 200, "b")]
    odd = make(spark, rows).withColumns({c: F.lit("clash") for c in ("rid", "row", "copy", "shard", "words", "kept_text", "quality", "h1", "n")})
    for k, table in enumerate((odd, odd.limit(0))):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
            assert name == "sentencepiece" or docs.columns == odd.columns
        assert (docs.count() > 0) == (k == 0)

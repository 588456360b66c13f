"""Sampled against full corpus: entropy, proportions and bias of topic distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topic_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("tier", "topic_id").agg(F.count(F.lit(1)).alias("n"))


def entropy(counts: DataFrame) -> DataFrame:
    """Entropy (bits) over topics without noise, the effective number 2^H, and the share of noise."""
    w = Window.partitionBy("tier")
    all_rows = counts.withColumn("whole", F.sum("n").over(w))
    real = all_rows.where("topic_id <> -1").withColumn("p", F.col("n") / F.sum("n").over(w))
    h = -F.sum(F.col("p") * F.log2("p"))
    out = real.groupBy("tier").agg(h.alias("h"), F.count(F.lit(1)).alias("n_topics"), F.sum("n").alias("real"), F.max("whole").alias("whole"))
    return out.select("tier", "n_topics", F.bround("h", 6).alias("entropy"), F.bround(F.pow(F.lit(2.0), "h"), 4).alias("effective_number"), F.bround(1 - F.col("real") / F.col("whole"), 6).alias("noise_rate"))


def macro_proportions(counts: DataFrame, macro: DataFrame) -> DataFrame:
    """Share of each macro-topic; noise counts in the denominator only."""
    whole = counts.withColumn("whole", F.sum("n").over(Window.partitionBy("tier")))
    named = whole.join(macro.select("tier", "topic_id", "macro_id"), ["tier", "topic_id"])
    return named.groupBy("tier", "macro_id").agg(F.bround(F.sum("n") / F.max("whole"), 6).alias("proportion"))


def compare(sampled: DataFrame, full: DataFrame, macro: DataFrame, top: int = 10) -> DataFrame:
    """The macro-topics whose shares differ most between sample and full corpus, with both entropies' difference."""
    s, f = topic_counts(sampled), topic_counts(full)
    side = lambda c, name: macro_proportions(c, macro).withColumnRenamed("proportion", name)
    both = side(s, "sampled").join(side(f, "full"), ["tier", "macro_id"], "full_outer").na.fill(0.0, ["sampled", "full"])
    both = both.withColumn("diff", F.bround(F.col("sampled") - F.col("full"), 6))
    ranked = both.withColumn("n", F.row_number().over(Window.partitionBy("tier").orderBy(F.abs("diff").desc(), "macro_id"))).where(F.col("n") <= top)
    h = entropy(s).select("tier", F.col("entropy").alias("hs")).join(entropy(f).select("tier", F.col("entropy").alias("hf")), "tier")
    out = ranked.join(h, "tier")
    return out.select("tier", "macro_id", "sampled", "full", "diff", F.bround(F.col("hs") - F.col("hf"), 6).alias("entropy_delta"), F.bround(F.try_divide((F.col("hs") - F.col("hf")) * 100, F.col("hf")), 4).alias("entropy_bias_pct"))

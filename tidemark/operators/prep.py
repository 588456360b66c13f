"""Cleaning, filtering, de-duplicating and sampling documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Tier
from tidemark.functions import scalars as S


def with_dates(df: DataFrame, column: str = "published") -> DataFrame:
    """Adds published_dt (null where the text is no date) and month."""
    return df.withColumn("published_dt", S.timestamp_of(F.col(column))).withColumn("month", S.month_key(F.col("published_dt")))


def in_categories(df: DataFrame, categories: Sequence[str], column: str = "primary_category") -> DataFrame:
    return df.where(F.col(column).isin(*categories))


def without_withdrawn(df: DataFrame, columns: Sequence[str] = ("title", "abstract")) -> DataFrame:
    """Drops rows that say "withdrawn" in any of the columns that exist."""
    hit = F.lit(False)
    for c in columns:
        if c in df.columns:
            hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("withdrawn"))
    return df.where(~hit)


def min_chars(df: DataFrame, n: int = 300, column: str = "text") -> DataFrame:
    return df.where(F.length(column) >= n)


def between_months(df: DataFrame, start: str, end: str, column: str = "month") -> DataFrame:
    return df.where(F.col(column).between(start, end))


def between_days(df: DataFrame, start: str, end: str, column: str = "published_dt") -> DataFrame:
    """Both days included to their last moment."""
    return df.where((F.col(column) >= F.lit(start).cast("timestamp")) & (F.col(column) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))


def with_text(df: DataFrame, title: str = "title", abstract: str = "abstract") -> DataFrame:
    return df.withColumn("text", F.concat(S.clean_text(F.col(title)), F.lit(". "), S.clean_text(F.col(abstract))))


def keep_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def first_by_id(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row for each id: the first in a stated order (files have none)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def latest_title(df: DataFrame, published: str = "published_dt", id_column: str = "doc_id") -> DataFrame:
    """Titles equal up to case, blanks and anything after 100 characters: the latest row stays, ties to the smaller id."""
    order = [F.col(published).desc_nulls_last(), F.col(id_column)]
    return first_by_id(df.withColumn("_key", S.title_key(F.coalesce("title", F.lit("")))), "_key", order).drop("_key")


def sampling_stats(raw: DataFrame, sampled: DataFrame, keys: Sequence[str] = ("month", "primary_category")) -> DataFrame:
    k = list(keys)
    there = lambda df, name: df.where(" and ".join(f"{c} is not null" for c in k)).groupBy(*k).agg(F.count(F.lit(1)).alias(name))
    both = there(raw, "raw_count").join(there(sampled, "sampled_count"), k, "left").na.fill(0, ["sampled_count"])
    return both.withColumn("sampling_rate", F.bround(F.col("sampled_count") / F.col("raw_count"), 4))


def dataset_stats(raw: DataFrame, clean: DataFrame, sampled: DataFrame, id_column: str = "doc_id", published: str = "published_dt") -> DataFrame:
    """One row of sizes and the date range."""
    a = raw.agg(F.count(F.lit(1)).alias("total_raw_records"), F.countDistinct(id_column).alias("total_unique_papers"), F.date_format(F.min(published), "yyyy-MM-dd").alias("start_date"), F.date_format(F.max(published), "yyyy-MM-dd").alias("end_date"))
    b = clean.agg(F.count(F.lit(1)).alias("total_clean_papers"))
    c = sampled.agg(F.count(F.lit(1)).alias("total_sampled_papers"))
    return a.join(b).join(c)  # one row each


def tier_of(month: Column, tiers: Sequence[Tier]) -> Column:
    out = F.lit(None).cast("string")
    for t in tiers:
        out = F.when(month.between(t.start, t.end), t.name).otherwise(out)
    return out


def prepare_tiers(df: DataFrame, tiers: Sequence[Tier], categories: Sequence[str]) -> DataFrame:
    """Every tier's cleaned documents in one plan: dates, tier, categories, withdrawals, text, latest titles by tier."""
    dated = df.withColumn("tier", tier_of(F.col("month"), tiers)).where("tier is not null")
    kept = without_withdrawn(in_categories(dated, categories)).withColumn("text", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit(""))))
    keyed = kept.withColumn("_key", S.title_key(F.coalesce("title", F.lit(""))))
    order = Window.partitionBy("tier", "_key").orderBy(F.col("month").desc_nulls_last(), "doc_id")
    return keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_key")


def hash_order(id_column: str, seed: int) -> Column:
    """A fixed random order that any engine with md5 can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")))


def stratified_sample(df: DataFrame, groups: Sequence[str], n: int, id_column: str = "doc_id", seed: int = 42) -> DataFrame:
    """Up to n rows of each group, in a fixed random order."""
    order = Window.partitionBy(*groups).orderBy(hash_order(id_column, seed), id_column)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def diversity_sample(df: DataFrame, groups: Sequence[str], cluster: str, target: int, pool_factor: float = 2.0, min_pool: int = 100, id_column: str = "doc_id", seed: int = 42) -> DataFrame:
    """Rows of each group spread over its clusters in proportion, at least one each, cut to ``target``.

    Whole groups stay where they hold no more than the target; groups with too small a pool are sampled plainly.
    """
    g = list(groups)
    sizes = df.groupBy(*g, cluster).agg(F.count(F.lit(1)).alias("_size"))
    pools = sizes.groupBy(*g).agg(F.sum("_size").alias("_pool"))
    quota = F.least(F.greatest(F.lit(1), F.floor(F.lit(target) * F.col("_size") / F.col("_pool"))), F.col("_size"))
    plan = sizes.join(pools, g).withColumn("_quota", quota.cast("long"))
    order = hash_order(id_column, seed)
    joined = df.join(plan, [*g, cluster]).withColumn("_order", order)
    joined = joined.withColumn("_in", F.row_number().over(Window.partitionBy(*g, cluster).orderBy("_order", id_column)))
    diverse = (F.col("_pool") >= pool_factor * target) & (F.col("_pool") >= min_pool)
    whole = F.col("_pool") <= target
    chosen = joined.where(whole | ~diverse | (F.col("_in") <= F.col("_quota")))
    cut = F.row_number().over(Window.partitionBy(*g).orderBy("_order", id_column))
    return chosen.withColumn("_cut", cut).where(whole | (F.col("_cut") <= target)).drop("_size", "_pool", "_quota", "_order", "_in", "_cut")

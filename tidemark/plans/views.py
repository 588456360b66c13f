"""Adapter views: the test tables in the shapes that the analyses expect, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import growth, topics
from tidemark.sources.readers import table

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SHORT = ("p1", "p2", "p3", "p4", "p5")
CATEGORIES = ("c0", "c1", "c2", "c3")
TIERS = ("T1_fine", "T2_medium", "T3_coarse", "T4_historic")
LABELS = ("2023-2026", "2020-2023", "2016-2020", "1998-2016")
STOP = ("the", "of", "and", "to", "in", "de", "la", "der", "die", "und", "que", "el", "en", "le", "les", "is")
TERMS = ("ing", "tion", "eau", "ung", "ción", "the")
PARADIGMS = {"gerund": ("ing", "ting"), "romance": ("eau", "ción"), "german": ("ung", "keit"), "absent": ("zzzz",)}
N_MACRO = 6


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


def months(spark: SparkSession, sf: str) -> DataFrame:
    return growth.monthly_counts(orders(spark, sf), "category")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents", spread=True).select("doc_id", F.substring(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0)), 1, 100).alias("title"), F.col("text").alias("abstract"), F.coalesce(F.substring("source", 4, 9).try_cast("int"), F.lit(0)).alias("src"))
    primary = (F.col("src") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)) % 4
    d = d.select("*", F.concat(F.lit("c"), F.col("src") % 4).alias("query_category"), F.concat(F.lit("c"), primary).alias("primary_category"), F.date_format(F.add_months(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 48).cast("int")), "yyyy-MM").alias("month"), (2020 + F.floor((F.col("doc_id") % 48) / 12)).cast("int").alias("year"))
    categories = F.concat(F.col("query_category"), F.when(F.col("query_category") != F.col("primary_category"), F.concat(F.lit("|"), "primary_category")).otherwise(""), F.when(F.col("doc_id") % 3 == 0, "|x").otherwise(""))
    published = F.when(F.col("doc_id") % 97 == 0, "unknown").otherwise(F.concat("month", F.lit("-15T00:00:00Z")))
    tier = F.when(F.col("year") == 2020, TIERS[3]).when(F.col("year") == 2021, TIERS[2]).when(F.col("year") == 2022, TIERS[1]).otherwise(TIERS[0])
    return d.select("*", categories.alias("categories"), published.alias("published"), tier.alias("tier"), F.when(F.col("doc_id") % 17 == 0, -1).otherwise(F.col("src")).alias("topic_id"))


DOCS = """
docs AS (
  SELECT *, query_category || CASE WHEN query_category <> primary_category THEN '|' || primary_category ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '|x' ELSE '' END AS categories,
    CASE WHEN doc_id % 97 = 0 THEN 'unknown' ELSE month || '-15T00:00:00Z' END AS published,
    CASE year WHEN 2020 THEN 'T4_historic' WHEN 2021 THEN 'T3_coarse' WHEN 2022 THEN 'T2_medium' ELSE 'T1_fine' END AS tier,
    CASE WHEN doc_id % 17 = 0 THEN -1 ELSE src END AS topic_id
  FROM (SELECT doc_id, substr(string_split(coalesce(text, ''), chr(10))[1], 1, 100) AS title, text AS abstract,
      coalesce(TRY_CAST(substr(source, 4, 9) AS INTEGER), 0) AS src, 'c' || (src % 4) AS query_category,
      'c' || ((src + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) % 4) AS primary_category,
      strftime(DATE '2020-01-01' + to_months(CAST(doc_id % 48 AS INTEGER)), '%Y-%m') AS month, CAST(2020 + (doc_id % 48) // 12 AS INTEGER) AS year
    FROM documents))"""
MONTHS = "months AS (SELECT o_orderpriority AS category, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1, 2)"


def info(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).groupBy("tier", "topic_id").agg(F.count(F.lit(1)).alias("paper_count"))


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    return topics.class_tfidf(docs(spark, sf).where("topic_id <> -1"), ["tier", "topic_id"], F.col("abstract"), STOP)


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    return topics.signatures(keywords(spark, sf), info(spark, sf))


def macro(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("tier") == TIERS[0], LABELS[0]).when(F.col("tier") == TIERS[1], LABELS[1]).when(F.col("tier") == TIERS[2], LABELS[2]).otherwise(LABELS[3])
    return signatures(spark, sf).select("tier", "topic_id", "paper_count", (F.col("topic_id") % N_MACRO).alias("macro_id"), "top5_kw", label.alias("tier_label"))


def macro_plain(spark: SparkSession, sf: str) -> DataFrame:
    """The macro table without keywords, for analyses of sizes alone."""
    return info(spark, sf).where("topic_id <> -1").select("tier", "topic_id", "paper_count", (F.col("topic_id") % N_MACRO).alias("macro_id"), F.when(F.col("tier") == TIERS[0], LABELS[0]).when(F.col("tier") == TIERS[1], LABELS[1]).when(F.col("tier") == TIERS[2], LABELS[2]).otherwise(LABELS[3]).alias("tier_label"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
INFO = "info AS (SELECT tier, topic_id, count(*) AS paper_count FROM docs GROUP BY 1, 2)"
MACRO_PLAIN = "macro AS (SELECT tier, topic_id, paper_count, topic_id % 6 AS macro_id, CASE tier WHEN 'T1_fine' THEN '2023-2026' WHEN 'T2_medium' THEN '2020-2023' WHEN 'T3_coarse' THEN '2016-2020' ELSE '1998-2016' END AS tier_label FROM info WHERE topic_id <> -1)"
KEYWORDS = rf"""
words AS (SELECT doc_id, tier, topic_id, list_filter(regexp_extract_all(lower(abstract), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([{_STOP_SQL}], w)) AS w FROM docs WHERE topic_id <> -1),
grams AS (SELECT doc_id, tier, topic_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS keyword FROM words),
tf AS (SELECT tier, topic_id, keyword, count(*) AS tf, count(DISTINCT doc_id) AS df FROM grams GROUP BY ALL),
fr AS (SELECT tier, keyword, sum(tf) AS f FROM tf GROUP BY ALL HAVING sum(df) >= 2),
tk AS (SELECT tf.*, f FROM tf JOIN fr USING (tier, keyword)),
ln AS (SELECT tier, topic_id, sum(tf) AS len FROM tk GROUP BY ALL),
av AS (SELECT tier, avg(len) AS a FROM ln GROUP BY ALL),
wt AS (SELECT tier, topic_id, keyword, round_even(tf / len * ln(1 + a / f), 6) AS weight FROM tk JOIN ln USING (tier, topic_id) JOIN av USING (tier)),
kw AS (SELECT tier, topic_id, CAST(rank AS INTEGER) AS rank, keyword, weight FROM (SELECT *, row_number() OVER (PARTITION BY tier, topic_id ORDER BY weight DESC, keyword) AS rank FROM wt) WHERE rank <= 10)"""
SIGNATURES = """
signed AS (SELECT kw.tier, kw.topic_id, any_value(paper_count) AS paper_count, string_agg(keyword, ' ' ORDER BY rank) AS keywords_str, string_agg(keyword, ', ' ORDER BY rank) FILTER (WHERE rank <= 5) AS top5_kw
  FROM kw JOIN info USING (tier, topic_id) GROUP BY ALL)"""
MACRO = "macro AS (SELECT tier, topic_id, paper_count, topic_id % 6 AS macro_id, top5_kw, CASE tier WHEN 'T1_fine' THEN '2023-2026' WHEN 'T2_medium' THEN '2020-2023' WHEN 'T3_coarse' THEN '2016-2020' ELSE '1998-2016' END AS tier_label FROM signed)"

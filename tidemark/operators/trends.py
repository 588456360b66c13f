"""Change points and monotone trends of short series."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels as K


def change_points(counts: DataFrame, penalty: float = 3.0, jump: int = 3, min_size: int = 6, min_months: int = 12, shift: int = 0) -> DataFrame:
    """(category, date, method) from kernel segmentation and recursive cumulative sums; a series is a few hundred rows."""

    def find(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("month")
        y, months = series["count"].to_numpy(float), series["month"].tolist()
        if len(y) < min_months:
            return pd.DataFrame({"category": [], "date": [], "method": []})
        kernel = {months[p - shift] for p in K.pelt_rbf(y, penalty * math.log(len(y)), jump, min_size) if p < len(y)}
        sums = {months[p - shift] for p in K.cusum_peaks(y)}
        rows = [(series["category"].iloc[0], m, "+".join(n for n, s in (("PELT", kernel), ("CUSUM", sums)) if m in s)) for m in sorted(kernel | sums)]
        return pd.DataFrame(rows, columns=["category", "date", "method"])

    return counts.select("category", "month", "count").groupBy("category").applyInPandas(find, "category string, date string, method string")


def structural_breaks(counts: DataFrame, min_rows: int = 24) -> DataFrame:
    """Change points on observed months, with the count of the month they name."""
    found = change_points(counts, min_months=min_rows, shift=1)
    return found.join(counts.withColumnRenamed("month", "date"), ["category", "date"]).select("category", "date", F.col("count").alias("papers"), "method")


def cusum_once(counts: DataFrame, margin: int = 12) -> DataFrame:
    """The first peak of the cumulative sum and whether it lies far enough from both ends, in plain SQL."""
    w = Window.partitionBy("category")
    centred = counts.withColumn("d", F.col("count") - F.avg("count").over(w)).withColumn("i", F.row_number().over(w.orderBy("month")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    path = centred.withColumn("s", F.bround(F.abs(F.sum("d").over(w.orderBy("month").rowsBetween(Window.unboundedPreceding, 0))), 6))
    peak = path.groupBy("category").agg(F.max(F.struct("s", (-F.col("i")).alias("j"), "month")).alias("p"), F.max("n").alias("n"))
    at = -F.col("p.j")
    return peak.select("category", F.col("p.month").alias("date"), at.cast("long").alias("position"), F.bround("p.s", 4).alias("statistic"), ((at >= margin) & (at <= F.col("n") - margin)).alias("accepted"))


def monthly_shares(assigned: DataFrame, top: int = 15, min_months: int = 6) -> DataFrame:
    """(tier, topic_id, i, y): monthly share of each tier's largest topics, zero where absent."""
    rows = assigned.where("month is not null and tier is not null")
    months = rows.groupBy("tier", "month").agg(F.count(F.lit(1)).alias("total"))
    months = months.withColumn("i", F.row_number().over(Window.partitionBy("tier").orderBy("month"))).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("tier"))).where(F.col("k") >= min_months)
    sizes = rows.where("topic_id <> -1").groupBy("tier", "topic_id").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.withColumn("n", F.row_number().over(Window.partitionBy("tier").orderBy(F.col("size").desc(), "topic_id"))).where(F.col("n") <= top).select("tier", "topic_id")
    counts = rows.groupBy("tier", "topic_id", "month").agg(F.count(F.lit(1)).alias("c"))
    grid = largest.join(months, "tier").join(counts, ["tier", "topic_id", "month"], "left")
    return grid.select("tier", "topic_id", "i", (F.coalesce("c", F.lit(0)) / F.col("total")).alias("y"))


def pairs(series: DataFrame) -> DataFrame:
    a = series.select("tier", "topic_id", F.col("i").alias("i1"), F.col("y").alias("y1"))
    b = series.select("tier", "topic_id", F.col("i").alias("i2"), F.col("y").alias("y2"))
    return a.join(b, ["tier", "topic_id"]).where("i1 < i2")  # series of a few hundred months


def kendall_tau(series: DataFrame) -> DataFrame:
    s = F.sum(F.when(F.col("y2") > F.col("y1"), 1).when(F.col("y2") < F.col("y1"), -1).otherwise(0))
    tied = F.sum(F.when(F.col("y2") == F.col("y1"), 1).otherwise(0))
    sums = pairs(series).groupBy("tier", "topic_id").agg(s.alias("s"), tied.alias("t"), F.count(F.lit(1)).alias("p"))
    tau = F.try_divide(F.col("s"), F.sqrt(F.col("p") * (F.col("p") - F.col("t")).cast("double")))
    return sums.where("p > t").select("tier", "topic_id", F.bround(tau, 6).alias("mk_tau"))


def theil_sen_slope(series: DataFrame) -> DataFrame:
    slope = (F.col("y2") - F.col("y1")) / (F.col("i2") - F.col("i1"))
    return pairs(series).groupBy("tier", "topic_id").agg(F.bround(F.percentile(slope, 0.5), 9).alias("ts_slope"))


def trend_table(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Tau, its p-value, the slope and its interval, and significance; one series at a time."""

    def of(part: pd.DataFrame) -> pd.DataFrame:
        y = part.sort_values("i")["y"].to_numpy(float)
        if y.std(ddof=1) < 1e-8:
            return pd.DataFrame({c: [] for c in ("tier", "topic_id", "mk_tau", "mk_pvalue", "ts_slope", "ts_slope_lo", "ts_slope_hi", "significant")})
        tau, p = K.kendall(y)
        slope, low, high = K.theil_sen(y)
        return pd.DataFrame([(part["tier"].iloc[0], part["topic_id"].iloc[0], tau, p, slope, low, high, bool(p < alpha))], columns=["tier", "topic_id", "mk_tau", "mk_pvalue", "ts_slope", "ts_slope_lo", "ts_slope_hi", "significant"])

    return series.groupBy("tier", "topic_id").applyInPandas(of, "tier string, topic_id int, mk_tau double, mk_pvalue double, ts_slope double, ts_slope_lo double, ts_slope_hi double, significant boolean")



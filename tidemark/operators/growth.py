"""Growth, volatility, seasonality, anomalies and correlation of monthly counts (category, month, count)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def by_month() -> Window:
    return Window.partitionBy("category").orderBy("month")


def monthly_counts(df: DataFrame, category: str, month: str = "month") -> DataFrame:
    keyed = df.where(F.col(category).isNotNull() & F.col(month).isNotNull())
    return keyed.groupBy(F.col(category).alias("category"), F.col(month).alias("month")).agg(F.count(F.lit(1)).alias("count"))


def year_over_year(counts: DataFrame) -> DataFrame:
    """Change against the same month a year before, by the calendar; null without one."""
    before = counts.select("category", F.date_format(F.add_months(S.month_start(F.col("month")), 12), "yyyy-MM").alias("month"), F.col("count").alias("before"))
    change = F.when(F.col("before") > 0, F.bround((F.col("count") - F.col("before")) / F.col("before") * 100, 1))
    return counts.join(before, ["category", "month"], "left").select("category", "month", "count", change.alias("yoy_pct"))


def acceleration(counts: DataFrame) -> DataFrame:
    """Change of the twelve-row growth rate: rows, not calendar months."""
    rate = F.try_divide(F.col("count"), F.lag("count", 12).over(by_month())) - 1
    rated = counts.withColumn("rate", rate)
    return rated.withColumn("acceleration", F.bround(F.col("rate") - F.lag("rate").over(by_month()), 6)).where("acceleration is not null").select("category", "month", "acceleration")


def multiples(counts: DataFrame, periods: Sequence[tuple[str, str, str]]) -> DataFrame:
    """End count over start count for each (label, start, end); an absent month counts 0, a start of 0 gives 0."""
    at = lambda m: F.coalesce(F.max(F.when(F.col("month") == m, F.col("count"))), F.lit(0)).cast("long")
    wide = counts.groupBy("category").agg(*[at(m).alias(f"{side}{i}") for i, p in enumerate(periods) for side, m in (("s", p[1]), ("e", p[2]))])
    each = F.explode(F.array(*[F.struct(F.lit(p[0]).alias("period"), F.col(f"s{i}").alias("start_count"), F.col(f"e{i}").alias("end_count")) for i, p in enumerate(periods)]))
    out = wide.select("category", each.alias("p")).select("category", "p.*")
    return out.withColumn("multiplier", F.when(F.col("start_count") > 0, F.bround(F.col("end_count") / F.col("start_count"), 1)).otherwise(F.lit(0.0)))


def volatility(counts: DataFrame, eras: Sequence[tuple[str, str, str]], min_months: int = 6, lose_first_month: bool = False, detrended: bool = False) -> DataFrame:
    """Spread of the counts of each era. ``lose_first_month`` compares month text with day text; ``detrended`` takes residuals of a line."""
    era = F.lit(None).cast("string")
    for label, start, end in eras:
        low = F.col("month") >= start if lose_first_month else F.col("month") >= start[:7]
        era = F.when(low & (F.col("month") <= end[:7]), label).otherwise(era)
    rows = counts.withColumn("era", era).where("era is not null")
    if detrended:
        w = Window.partitionBy("category", "era")
        x = F.months_between(S.month_start(F.col("month")), F.lit("1970-01-01"))
        rows = rows.withColumn("x", x).withColumn("slope", F.regr_slope("count", "x").over(w)).withColumn("at", F.regr_intercept("count", "x").over(w))
        spread = F.stddev_samp(F.col("count") - F.col("slope") * F.col("x") - F.col("at"))
    else:
        spread = F.stddev_samp("count")
    out = rows.groupBy("category", "era").agg(F.avg("count").alias("m"), spread.alias("s"), F.min("count").alias("min"), F.max("count").alias("max"), F.count(F.lit(1)).alias("n_months"))
    return out.where(F.col("n_months") >= min_months).select("category", "era", F.bround("m", 1).alias("mean"), F.bround("s", 1).alias("std"), F.bround(F.try_divide(F.col("s"), F.col("m")), 4).alias("cv"), "min", "max", "n_months")


def seasonal(counts: DataFrame) -> DataFrame:
    """Deviation from the year's mean, by month of the year."""
    w = Window.partitionBy("category", F.substring("month", 1, 4))
    factor = counts.withColumn("pct", (F.col("count") / F.avg("count").over(w) - 1) * 100).withColumn("month", F.substring("month", 6, 2).cast("int"))
    return factor.groupBy("category", "month").agg(F.bround(F.avg("pct"), 4).alias("seasonal_pct"), F.bround(F.stddev_samp("pct"), 4).alias("std_pct"))


def month_pair_effect(counts: DataFrame, category: str, years: Sequence[int], months: tuple[str, str, str] = ("02", "03", "04")) -> DataFrame:
    """Jump into and drop out of the middle month, by year, where the first has any."""
    at = lambda m: F.coalesce(F.sum(F.when(F.substring("month", 6, 2) == m, F.col("count"))), F.lit(0)).cast("long")
    rows = counts.where(F.col("category") == category).groupBy(F.substring("month", 1, 4).cast("int").alias("year")).agg(at(months[0]).alias("feb"), at(months[1]).alias("mar"), at(months[2]).alias("apr"))
    kept = rows.where(F.col("year").isin(*years) & (F.col("feb") > 0))
    pct = lambda a, b: F.bround((F.try_divide(F.col(a), F.col(b)) - 1) * 100, 4)
    return kept.select("year", "feb", "mar", "apr", pct("mar", "feb").alias("mar_jump_pct"), pct("apr", "mar").alias("apr_drop_pct"))


def anomalies(counts: DataFrame, window: int = 12, min_rows: int = 6, top: int = 10, signed: bool = False) -> DataFrame:
    """The months farthest from their trailing mean."""
    w = by_month().rowsBetween(-(window - 1), 0)
    mean = F.when(F.count("count").over(w) >= min_rows, F.avg("count").over(w))
    rows = counts.withColumn("ma", mean).where("ma is not null").withColumn("dev", (F.col("count") - F.col("ma")) / F.col("ma") * 100)
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy(F.bround(F.abs("dev"), 9).desc(), "month")))
    value = F.col("dev") if signed else F.abs("dev")
    return ranked.where(F.col("n") <= top).select("category", "month", F.col("count").alias("actual"), F.col("ma").cast("long").alias("expected_ma12"), F.bround(value, 4).alias("deviation_pct"))


def wide(counts: DataFrame, categories: Sequence[str]) -> DataFrame:
    """A column for each category, zero where it has no row."""
    return counts.groupBy("month").pivot("category", list(categories)).agg(F.sum("count")).na.fill(0)


def shares(counts: DataFrame, categories: Sequence[str], names: Sequence[str]) -> DataFrame:
    table = wide(counts, categories).select("month", *[F.col(f"`{c}`").alias(n) for c, n in zip(categories, names)])
    total: Column = F.lit(0)
    for n in names:
        total = total + F.col(n)
    table = table.withColumn("total", total.cast("long"))
    return table.select("*", *[F.bround(F.try_divide(F.col(n) * 100.0, F.col("total")), 2).alias(f"{n}_share") for n in names])


def three_month_growth(counts: DataFrame, categories: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Change over three rows of the zero-filled table; null where the base is 0 (the limit the source leaves infinite)."""
    table = wide(counts, categories).select("month", *[F.col(f"`{c}`").alias(n) for c, n in zip(categories, names)])
    w = Window.orderBy("month")  # months alone, a few hundred rows after the pivot
    return table.select("month", *[(F.try_divide(F.col(n), F.lag(n, 3).over(w)) - 1).alias(n) for n in names])


def growth_correlation(counts: DataFrame, categories: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Pearson correlation of three-month growth for each pair, long."""
    growth = three_month_growth(counts, categories, names)
    for n in names:
        growth = growth.where(F.col(n).isNotNull())
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = growth.agg(*[F.bround(F.corr(a, b), 6).alias(f"{a}~{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("cat1"), F.lit(b).alias("cat2"), F.col(f"{a}~{b}").alias("corr")) for a, b in pairs])).alias("r")).select("r.*")


def growth_convergence(counts: DataFrame, categories: Sequence[str], names: Sequence[str], mean_with_std: bool = False) -> DataFrame:
    """Mean and spread of three-month growth over the categories. ``mean_with_std`` averages the spread in, as the source does."""
    growth = three_month_growth(counts, categories, names)
    for n in names:
        growth = growth.where(F.col(n).isNotNull())
    long = growth.select("month", F.explode(F.array(*names)).alias("g")).groupBy("month").agg(F.stddev_samp("g").alias("s"), F.avg("g").alias("m"), F.sum("g").alias("t"))
    mean = (F.col("t") + F.col("s")) / (len(names) + 1) if mean_with_std else F.col("m")
    return long.select("month", F.bround("s", 6).alias("growth_std"), F.bround(mean, 6).alias("growth_mean"))


def calendar_spine(counts: DataFrame) -> DataFrame:
    """Every month between a category's first and last, zero where it has no row; months as their last day."""
    ends = counts.groupBy("category").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    spine = ends.select("category", F.explode(S.month_range(S.month_start(F.col("a")), S.month_start(F.col("b")))).alias("month"))
    full = spine.join(counts, ["category", "month"], "left").na.fill(0, ["count"])
    return full.select("category", F.last_day(S.month_start(F.col("month"))).alias("month"), "count")

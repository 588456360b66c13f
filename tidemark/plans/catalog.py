"""All queries of the engine by name, and the SQL that a second engine answers them with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import Tier
from tidemark.functions import scalars as S
from tidemark.operators import advanced, density, encoder, experiments, final, growth, manifold, models, neighbours, prep, sampling, topics, trends
from tidemark.plans import views as V
from tidemark.sources.readers import table
from tidemark.streaming import counts as streaming
from tidemark.streaming import running
from tidemark.tables import forget, small, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PERIODS = (("whole", "1995-01", "2001-07"), ("early", "1995-06", "1997-06"), ("late", "1998-01", "2002-01"))
ERAS = (("90s", "1995-03-01", "1998-12-31"), ("turn", "1999-01-01", "2000-12-31"), ("end", "2001-01-01", "2001-12-31"))
DOC_TIERS = (Tier("T1_fine", "a", "2023-01", "2023-12", "month", 5), Tier("T2_medium", "b", "2022-01", "2022-12", "month", 5), Tier("T4_historic", "c", "2020-03", "2020-11", "year", 9))
PRE, POST = ("1995-01", "1999-06"), ("1999-07", "2001-12")


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its oracle after the named views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            own = body.startswith("WITH")
            parts = [*views, body[4:].strip()] if own else list(views)
            if parts:
                body = "WITH RECURSIVE " + ",\n".join(parts) + ("" if own else f"\n{body}")
            ORACLES[f.__name__] = body
        return f

    return add


#: Change points of the table ``src`` (category, month, count), in the steps of the kernels: the pruned recursion over a
#: grid of ends for the segmentation, three levels of peaks for the cumulative sums.
_CHANGES = """
ser AS (SELECT category, list(month ORDER BY month) AS m, list(CAST(count AS DOUBLE) ORDER BY month) AS y, CAST(count(*) AS BIGINT) AS n FROM src GROUP BY 1 HAVING count(*) >= {least}),
pt AS (SELECT category, i, y[i] AS v FROM (SELECT category, y, unnest(range(1, n + 1)) AS i FROM ser)),
med AS (SELECT a.category, median(pow(a.v - b.v, 2)) AS h FROM pt a JOIN pt b ON a.category = b.category AND a.i < b.i GROUP BY 1),
kern AS (SELECT a.category, a.i, b.i AS j, CASE WHEN h > 0 THEN exp(-pow(a.v - b.v, 2) / h) WHEN a.v = b.v THEN 1.0 ELSE 0.0 END AS k FROM pt a JOIN pt b ON a.category = b.category JOIN med ON med.category = a.category),
grid AS (SELECT category, n, list_concat(list_concat([0], list_filter(range(3, n, 3), lambda t: t >= 6)), [n]) AS g FROM ser),
cell AS (SELECT category, a, b, g[a] AS lo, g[b] AS hi FROM (SELECT category, g, a, unnest(range(a + 1, len(g) + 1)) AS b FROM (SELECT category, g, unnest(range(1, len(g) + 1)) AS a FROM grid))),
cost AS (SELECT c.category, a, b, any_value(hi - lo) - sum(k) / any_value(hi - lo) AS c FROM cell c JOIN kern ON kern.category = c.category AND i > lo AND i <= hi AND j > lo AND j <= hi GROUP BY ALL),
cols AS (SELECT category, list(col ORDER BY b) AS cc FROM (SELECT category, b, list(c ORDER BY a) AS col FROM cost GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT category, g, cc, 3 * ln(n) AS pen, CAST(1 AS BIGINT) AS k, [CAST(1 AS BIGINT)] AS alive, [-3 * ln(n)] AS best, [CAST(0 AS BIGINT)] AS prev FROM grid JOIN cols USING (category) WHERE n >= 12
  UNION ALL SELECT category, g, cc, pen, k + 1, CASE WHEN v IS NULL THEN alive ELSE list_append(list_filter(alive, lambda s: g[k + 1] - g[s] < 6 OR best[s] + cc[k][s] <= v), k + 1) END,
    list_append(best, v), list_append(prev, opts[list_position(vals, v)])
  FROM (SELECT *, list_min(vals) AS v FROM (SELECT *, list_transform(opts, lambda s: best[s] + cc[k][s] + pen) AS vals FROM (SELECT *, list_filter(alive, lambda s: g[k + 1] - g[s] >= 6) AS opts FROM st WHERE k < len(g))))),
bt AS (SELECT category, g, prev, prev[len(g)] AS k FROM st WHERE k = len(g) UNION ALL SELECT category, g, prev, prev[k] FROM bt WHERE k > 1),
pelt AS (SELECT DISTINCT category, g[k] AS p FROM bt WHERE k > 1),
cu AS (SELECT category, CAST(0 AS BIGINT) AS lo, n AS hi, 3 AS depth FROM ser
  UNION ALL SELECT category, unnest([lo, lo + p + 1]), unnest([lo + p, hi]), depth - 1 FROM
    (SELECT *, list_position(path, list_max(path)) - 1 AS p FROM (SELECT category, lo, hi, depth, list_transform(range(1, hi - lo + 1), lambda i: abs(list_sum(y[lo + 1:lo + i]) - i * list_avg(y[lo + 1:hi]))) AS path FROM cu JOIN ser USING (category) WHERE depth > 0 AND hi - lo >= 24))
    WHERE p BETWEEN 12 AND hi - lo - 12),
cusum AS (SELECT DISTINCT category, a.hi AS p FROM cu a JOIN cu b USING (category) JOIN ser USING (category) WHERE a.depth = b.depth AND b.lo = a.hi + 1 AND a.depth < 3 AND a.hi > 1 AND a.hi < n - 1),
changes AS (SELECT category, m[p + 1 - {shift}] AS date, CASE WHEN pelt.p IS NULL THEN 'CUSUM' WHEN cusum.p IS NULL THEN 'PELT' ELSE 'PELT+CUSUM' END AS method FROM pelt FULL JOIN cusum USING (category, p) JOIN ser USING (category))"""


# --- growth -------------------------------------------------------------------------------------------------------


@query("SELECT * FROM months", V.MONTHS)
def g1_monthly_counts(spark, sf):
    return V.months(spark, sf)


@query(
    """SELECT a.category, a.month, a.count, CASE WHEN b.count > 0 THEN round_even((a.count - b.count) / b.count * 100, 1) END AS yoy_pct
FROM months a LEFT JOIN months b ON a.category = b.category AND b.month = strftime(strptime(a.month || '-01', '%Y-%m-%d') - INTERVAL 12 MONTH, '%Y-%m')""",
    V.MONTHS,
)
def g2_yoy(spark, sf):
    return growth.year_over_year(V.months(spark, sf))


@query(
    """WITH r AS (SELECT *, count / lag(count, 12) OVER w - 1 AS rate FROM months WINDOW w AS (PARTITION BY category ORDER BY month)),
d AS (SELECT category, month, round_even(rate - lag(rate) OVER (PARTITION BY category ORDER BY month), 6) AS acceleration FROM r)
SELECT * FROM d WHERE acceleration IS NOT NULL""",
    V.MONTHS,
)
def g3_acceleration(spark, sf):
    return growth.acceleration(V.months(spark, sf))


@query(
    """WITH p(period, a, b) AS (VALUES ('whole', '1995-01', '2001-07'), ('early', '1995-06', '1997-06'), ('late', '1998-01', '2002-01')),
x AS (SELECT category, period, coalesce(max(count) FILTER (WHERE month = a), 0) AS start_count, coalesce(max(count) FILTER (WHERE month = b), 0) AS end_count FROM months, p GROUP BY ALL)
SELECT *, CASE WHEN start_count > 0 THEN round_even(end_count / start_count, 1) ELSE 0.0 END AS multiplier FROM x""",
    V.MONTHS,
)
def g4_multiples(spark, sf):
    return growth.multiples(V.months(spark, sf), PERIODS)


_ERAS_SQL = "e(era, a, b) AS (VALUES ('90s', '1995-03', '1998-12'), ('turn', '1999-01', '2000-12'), ('end', '2001-01', '2001-12'))"


@query(
    """SELECT category, era, round_even(avg(count), 1) AS mean, round_even(stddev_samp(count), 1) AS std, round_even(stddev_samp(count) / avg(count), 4) AS cv, min(count) AS min, max(count) AS max, count(*) AS n_months
FROM months JOIN e ON month BETWEEN a AND b GROUP BY ALL HAVING count(*) >= 6""",
    V.MONTHS,
    _ERAS_SQL,
)
def g5_volatility(spark, sf):
    return growth.volatility(V.months(spark, sf), ERAS)


@query(
    """WITH x AS (SELECT *, datediff('month', DATE '1970-01-01', CAST(month || '-01' AS DATE)) AS x FROM months JOIN e ON month BETWEEN a AND b),
f AS (SELECT category, era, regr_slope(count, x) AS s, regr_intercept(count, x) AS i FROM x GROUP BY ALL)
SELECT category, era, round_even(avg(count), 1) AS mean, round_even(stddev_samp(count - s * x - i), 1) AS std, round_even(stddev_samp(count - s * x - i) / avg(count), 4) AS cv, min(count) AS min, max(count) AS max, count(*) AS n_months
FROM x JOIN f USING (category, era) GROUP BY ALL HAVING count(*) >= 6""",
    V.MONTHS,
    _ERAS_SQL,
)
def g5_volatility_detrended(spark, sf):
    return growth.volatility(V.months(spark, sf), ERAS, detrended=True)


@query(
    """WITH x AS (SELECT category, CAST(substr(month, 6, 2) AS INTEGER) AS month, (count / avg(count) OVER (PARTITION BY category, substr(month, 1, 4)) - 1) * 100 AS pct FROM months)
SELECT category, month, round_even(avg(pct), 4) AS seasonal_pct, round_even(stddev_samp(pct), 4) AS std_pct FROM x GROUP BY ALL""",
    V.MONTHS,
)
def g6_seasonal(spark, sf):
    return growth.seasonal(V.months(spark, sf))


@query(
    """WITH x AS (SELECT CAST(substr(month, 1, 4) AS INTEGER) AS year, CAST(coalesce(sum(count) FILTER (WHERE month LIKE '%-02'), 0) AS BIGINT) AS feb, CAST(coalesce(sum(count) FILTER (WHERE month LIKE '%-03'), 0) AS BIGINT) AS mar, CAST(coalesce(sum(count) FILTER (WHERE month LIKE '%-04'), 0) AS BIGINT) AS apr
  FROM months WHERE category = '2-HIGH' GROUP BY 1)
SELECT *, round_even((mar / feb - 1) * 100, 4) AS mar_jump_pct, CASE WHEN mar > 0 THEN round_even((apr / mar - 1) * 100, 4) END AS apr_drop_pct FROM x WHERE year BETWEEN 1996 AND 2000 AND feb > 0""",
    V.MONTHS,
)
def g7_pair_month_effect(spark, sf):
    return growth.month_pair_effect(V.months(spark, sf), "2-HIGH", range(1996, 2001))


@query(
    """WITH x AS (SELECT *, avg(count) OVER w AS ma, count(*) OVER w AS k FROM months WINDOW w AS (PARTITION BY category ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, (count - ma) / ma * 100 AS dev FROM x WHERE k >= 6),
z AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round_even(abs(dev), 9) DESC, month) AS n FROM y)
SELECT category, month, count AS actual, CAST(trunc(ma) AS BIGINT) AS expected_ma12, round_even(abs(dev), 4) AS deviation_pct FROM z WHERE n <= 10""",
    V.MONTHS,
)
def g8_anomalies(spark, sf):
    return growth.anomalies(V.months(spark, sf))


@query("SELECT category, date, months.count AS papers, method FROM changes JOIN months USING (category) WHERE months.month = date", V.MONTHS, "src AS (SELECT * FROM months)", _CHANGES.format(least=24, shift=1))
def g9_structural_breaks(spark, sf):
    return trends.structural_breaks(V.months(spark, sf))


_WIDE = "wide AS (SELECT month, " + ", ".join(f"coalesce(sum(count) FILTER (WHERE category = '{c}'), 0) AS {n}" for c, n in zip(V.PRIORITIES, V.SHORT)) + " FROM months GROUP BY 1)"
_GROWTH = "g AS (SELECT * FROM (SELECT month, " + ", ".join(f"CASE WHEN lag({n}, 3) OVER w <> 0 THEN {n} / lag({n}, 3) OVER w - 1 END AS {n}" for n in V.SHORT) + " FROM wide WINDOW w AS (ORDER BY month)) WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in V.SHORT) + ")"


@query(
    "SELECT month, " + ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in V.SHORT) + ", CAST(p1 + p2 + p3 + p4 + p5 AS BIGINT) AS total, " + ", ".join(f"round_even({n} * 100.0 / (p1 + p2 + p3 + p4 + p5), 2) AS {n}_share" for n in V.SHORT) + " FROM wide",
    V.MONTHS,
    _WIDE,
)
def g10_shares(spark, sf):
    return growth.shares(V.months(spark, sf), V.PRIORITIES, V.SHORT)


@query(" UNION ALL ".join(f"SELECT '{a}' AS cat1, '{b}' AS cat2, round_even(corr({a}, {b}), 6) AS corr FROM g" for i, a in enumerate(V.SHORT) for b in V.SHORT[i + 1 :]), V.MONTHS, _WIDE, _GROWTH)
def g11_growth_corr(spark, sf):
    return growth.growth_correlation(V.months(spark, sf), V.PRIORITIES, V.SHORT)


@query("SELECT month, round_even(stddev_samp(v), 6) AS growth_std, round_even(avg(v), 6) + 0.0 AS growth_mean FROM (SELECT month, unnest([p1, p2, p3, p4, p5]) AS v FROM g) GROUP BY month", V.MONTHS, _WIDE, _GROWTH)
def g12_growth_convergence(spark, sf):
    return growth.growth_convergence(V.months(spark, sf), V.PRIORITIES, V.SHORT)


@query(
    """WITH w AS (SELECT DISTINCT unnest(string_split(keywords_str, ' ')[1:3]) AS keyword FROM signed)
SELECT keyword, count(DISTINCT tier) AS n_tiers FROM signed JOIN w ON contains(keywords_str, keyword) WHERE keyword <> '' GROUP BY 1 HAVING count(DISTINCT tier) >= 3""",
    V.DOCS, V.INFO, V.KEYWORDS, V.SIGNATURES,
)
def g13_persistent_keywords(spark, sf):
    return topics.persistent_keywords(V.signatures(spark, sf))


_FREQUENCY = """freq AS (SELECT tier, keyword, frequency FROM (SELECT tier, keyword, count(*) AS frequency, row_number() OVER (PARTITION BY tier ORDER BY count(*) DESC, keyword) AS r
  FROM (SELECT tier, unnest(string_split(keywords_str, ' ')) AS keyword FROM signed) GROUP BY 1, 2) WHERE r <= 30
  AND keyword NOT IN ('model', 'models', 'learning', 'data', 'using', 'based', 'method', 'approach', 'new', 'via', 'training', 'paper', 'performance'))"""


@query("SELECT * FROM freq", V.DOCS, V.INFO, V.KEYWORDS, V.SIGNATURES, _FREQUENCY)
def g14_keyword_frequency(spark, sf):
    return topics.keyword_frequency(V.signatures(spark, sf))


@query("SELECT count(*) AS total_papers, count(DISTINCT query_category) AS n_categories, count(DISTINCT month) AS n_months, min(month) AS first_month, max(month) AS last_month FROM docs", V.DOCS)
def g15_summary(spark, sf):
    return V.docs(spark, sf).agg(F.count(F.lit(1)).alias("total_papers"), F.countDistinct("query_category").alias("n_categories"), F.countDistinct("month").alias("n_months"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


# --- change points and trends -------------------------------------------------------------------------------------


@query(
    "SELECT * FROM changes WHERE method LIKE 'PELT%'",
    V.MONTHS,
    "src AS (SELECT category, month, count * CASE WHEN month < '1997-03' THEN 1 WHEN month < '1999-08' THEN 6 ELSE 2 END AS count FROM months)",
    _CHANGES.format(least=12, shift=0),
)
def c1_pelt(spark, sf):
    """On counts with two steps: the tables' own have none."""
    stepped = F.col("count") * F.when(F.col("month") < "1997-03", 1).when(F.col("month") < "1999-08", 6).otherwise(2)
    return trends.change_points(V.months(spark, sf).withColumn("count", stepped)).where("method like 'PELT%'")


@query(
    """WITH d AS (SELECT *, count - avg(count) OVER (PARTITION BY category) AS d, row_number() OVER (PARTITION BY category ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM months),
s AS (SELECT *, round_even(abs(sum(d) OVER (PARTITION BY category ORDER BY month ROWS UNBOUNDED PRECEDING)), 6) AS s FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY s DESC, i) AS r FROM s)
SELECT category, month AS date, CAST(i AS BIGINT) AS position, round_even(s, 4) AS statistic, i >= 12 AND i <= n - 12 AS accepted FROM p WHERE r = 1""",
    V.MONTHS,
)
def c2_cusum_depth1(spark, sf):
    return trends.cusum_once(V.months(spark, sf))


_SPINE = """spine AS (SELECT category, strftime(unnest(generate_series(CAST(a || '-01' AS DATE), CAST(b || '-01' AS DATE), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM (SELECT category, min(month) AS a, max(month) AS b FROM months GROUP BY 1)),
src AS (SELECT category, month, coalesce(count, 0) AS count FROM spine LEFT JOIN months USING (category, month))"""


@query("SELECT * FROM changes", V.MONTHS, _SPINE, _CHANGES.format(least=12, shift=0))
def c3_change_points(spark, sf):
    spine = growth.calendar_spine(V.months(spark, sf)).withColumn("month", F.date_format("month", "yyyy-MM"))
    return trends.change_points(spine)


@query(
    """WITH e AS (SELECT category, min(month) AS a, max(month) AS b FROM months GROUP BY 1),
s AS (SELECT category, unnest(generate_series(CAST(a || '-01' AS DATE), CAST(b || '-01' AS DATE), INTERVAL 1 MONTH)) AS d FROM e)
SELECT s.category, last_day(CAST(d AS DATE)) AS month, coalesce(count, 0) AS count FROM s LEFT JOIN months m ON m.category = s.category AND m.month = strftime(d, '%Y-%m')""",
    V.MONTHS,
)
def c4_calendar_spine(spark, sf):
    return growth.calendar_spine(V.months(spark, sf))


_SERIES = """
mo AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY month) AS i, count(*) OVER (PARTITION BY tier) AS k FROM (SELECT tier, month, count(*) AS total FROM docs GROUP BY 1, 2)),
sz AS (SELECT tier, topic_id FROM (SELECT tier, topic_id, row_number() OVER (PARTITION BY tier ORDER BY count(*) DESC, topic_id) AS r FROM docs WHERE topic_id <> -1 GROUP BY 1, 2) WHERE r <= 15),
ct AS (SELECT tier, topic_id, month, count(*) AS c FROM docs GROUP BY ALL),
series AS (SELECT sz.tier, sz.topic_id, i, coalesce(c, 0) / total AS y FROM sz JOIN mo ON sz.tier = mo.tier AND k >= 6 LEFT JOIN ct ON ct.tier = sz.tier AND ct.topic_id = sz.topic_id AND ct.month = mo.month),
pr AS (SELECT a.tier, a.topic_id, a.i AS i1, b.i AS i2, a.y AS y1, b.y AS y2 FROM series a JOIN series b ON a.tier = b.tier AND a.topic_id = b.topic_id AND a.i < b.i)"""


def _series(spark, sf):
    return trends.monthly_shares(V.docs(spark, sf))


@query(
    """WITH t AS (SELECT tier, topic_id, sum(CASE WHEN y2 > y1 THEN 1 WHEN y2 < y1 THEN -1 ELSE 0 END) AS s, count(*) FILTER (WHERE y1 = y2) AS t, count(*) AS p FROM pr GROUP BY ALL)
SELECT tier, topic_id, round_even(s / sqrt(p * (p - t)), 6) AS mk_tau FROM t WHERE p > t""",
    V.DOCS,
    _SERIES,
)
def c5_kendall_tau(spark, sf):
    return trends.kendall_tau(_series(spark, sf))


@query("SELECT tier, topic_id, round_even(median((y2 - y1) / (i2 - i1)), 9) AS ts_slope FROM pr GROUP BY ALL", V.DOCS, _SERIES)
def c6_theil_sen_slope(spark, sf):
    return trends.theil_sen_slope(_series(spark, sf))


@query(
    """WITH l AS (SELECT tier, topic_id, count(*) AS n, stddev_samp(y) AS sd FROM series GROUP BY ALL),
u AS (SELECT tier, topic_id, sum(k * (k - 1) * (2 * k + 5)) AS u FROM (SELECT tier, topic_id, y, CAST(count(*) AS DOUBLE) AS k FROM series GROUP BY ALL) GROUP BY ALL),
t AS (SELECT tier, topic_id, sum(CASE WHEN y2 > y1 THEN 1 WHEN y2 < y1 THEN -1 ELSE 0 END) AS s, count(*) FILTER (WHERE y1 = y2) AS t, count(*) AS p, list((y2 - y1) / (i2 - i1) ORDER BY (y2 - y1) / (i2 - i1)) AS slopes FROM pr GROUP BY ALL),
v AS (SELECT *, (n * (n - 1) * (2 * n + 5) - u) / 18 AS variance FROM t JOIN l USING (tier, topic_id) JOIN u USING (tier, topic_id) WHERE sd >= 1e-8 AND p > t),
z AS (SELECT *, abs(s) / sqrt(variance) / sqrt(2) AS x, 1.959963984540054 * sqrt(greatest(0, variance)) AS reach FROM v),
e AS (SELECT *, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * pow(x, 2 * k + 1) / exp(lgamma(k + 1)) / (2 * k + 1))) AS pv FROM z)
SELECT tier, topic_id, round_even(s / sqrt(p * (p - t)), 6) AS mk_tau, round_even(pv, 6) AS mk_pvalue, round_even(list_median(slopes), 9) AS ts_slope, round_even(slopes[greatest(0, CAST(round_even((p - reach) / 2, 0) AS BIGINT) - 1) + 1], 9) AS ts_slope_lo,
  round_even(slopes[least(p - 1, CAST(round_even((p + reach) / 2, 0) AS BIGINT)) + 1], 9) AS ts_slope_hi, pv < 0.05 AS significant FROM e""",
    V.DOCS,
    _SERIES,
)
def c7_trend_table(spark, sf):
    places = {"mk_tau": 6, "mk_pvalue": 6, "ts_slope": 9, "ts_slope_lo": 9, "ts_slope_hi": 9}
    return trends.trend_table(_series(spark, sf)).withColumns({c: F.bround(c, n) for c, n in places.items()})


# --- preparation --------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN doc_id % 97 <> 0 THEN month END AS month, CAST(CASE WHEN doc_id % 97 <> 0 THEN year END AS INTEGER) AS year, CASE WHEN doc_id % 97 <> 0 THEN year || 'Q' || quarter(CAST(month || '-01' AS DATE)) END AS quarter FROM docs", V.DOCS)
def p1_dates(spark, sf):
    d = prep.with_dates(V.docs(spark, sf).drop("month", "year"))
    return d.select("doc_id", "month", F.year("published_dt").alias("year"), S.quarter_key(F.col("published_dt")).alias("quarter"))


@query("SELECT doc_id, primary_category FROM docs WHERE primary_category IN ('c0', 'c2')", V.DOCS)
def p2_category_filter(spark, sf):
    return prep.in_categories(V.docs(spark, sf), ["c0", "c2"]).select("doc_id", "primary_category")


@query("SELECT doc_id FROM docs WHERE NOT contains(lower(coalesce(title, '')), 'withdrawn') AND NOT contains(lower(coalesce(abstract, '')), 'withdrawn')", V.DOCS)
def p4_withdrawn(spark, sf):
    return prep.without_withdrawn(V.docs(spark, sf)).select("doc_id")


@query("SELECT doc_id, length(abstract) AS n FROM docs WHERE length(abstract) >= 300", V.DOCS)
def p5_short_text(spark, sf):
    return prep.min_chars(V.docs(spark, sf), 300, "abstract").select("doc_id", F.length("abstract").cast("long").alias("n"))


@query("SELECT doc_id, month FROM docs WHERE month BETWEEN '2021-02' AND '2021-09'", V.DOCS)
def p6_tier_slice(spark, sf):
    return prep.between_months(V.docs(spark, sf), "2021-02", "2021-09").select("doc_id", "month")


@query("SELECT doc_id, month FROM docs WHERE doc_id % 97 <> 0 AND month || '-15' BETWEEN '2021-03-15' AND '2021-11-15'", V.DOCS)
def p7_day_range(spark, sf):
    return prep.between_days(prep.with_dates(V.docs(spark, sf)), "2021-03-15", "2021-11-15").select("doc_id", "month")


@query(r"SELECT doc_id, md5(trim(regexp_replace(coalesce(title, ''), '[\s\x0B\x{0085}\x{00A0}\x{2028}\x{2029}]+', ' ', 'g')) || '. ' || trim(regexp_replace(coalesce(abstract, ''), '[\s\x0B\x{0085}\x{00A0}\x{2028}\x{2029}]+', ' ', 'g'))) AS text_md5 FROM docs", V.DOCS)
def p9_build_text(spark, sf):
    return prep.with_text(V.docs(spark, sf)).select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, md5(lower(coalesce(title, '') || ' ' || coalesce(abstract, ''))) AS t FROM docs", V.DOCS)
def p10_analysis_text(spark, sf):
    return V.docs(spark, sf).select("doc_id", F.md5(F.lower(S.analysis_text(F.col("title"), F.col("abstract")))).alias("t"))


_TITLES = r"keyed AS (SELECT *, substr(trim(regexp_replace(lower(coalesce(title, '')), '[\s\x0B\x{0085}\x{00A0}\x{2028}\x{2029}]+', ' ', 'g')), 1, 100) AS tk, CASE WHEN doc_id % 97 <> 0 THEN month END AS mo FROM docs)"


@query("SELECT src, min(doc_id) AS doc_id FROM docs GROUP BY src", V.DOCS)
def d1_dedup(spark, sf):
    return prep.first_by_id(V.docs(spark, sf), "src", [F.col("doc_id")]).select("src", "doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY tk ORDER BY mo DESC NULLS LAST, doc_id) AS n FROM keyed) WHERE n = 1", V.DOCS, _TITLES)
def d2_title_dedup(spark, sf):
    return prep.latest_title(prep.with_dates(V.docs(spark, sf))).select("doc_id")


_SAMPLED = "sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY month, primary_category ORDER BY md5('42:' || doc_id), doc_id) AS n FROM docs) WHERE n <= 3)"


@query(
    """SELECT month, primary_category, raw_count, coalesce(k, 0) AS sampled_count, round_even(coalesce(k, 0) / raw_count, 4) AS sampling_rate
FROM (SELECT month, primary_category, count(*) AS raw_count FROM docs GROUP BY 1, 2) LEFT JOIN (SELECT month, primary_category, count(*) AS k FROM sampled GROUP BY 1, 2) USING (month, primary_category)""",
    V.DOCS,
    _SAMPLED,
)
def d3_sampling_stats(spark, sf):
    d = V.docs(spark, sf)
    return prep.sampling_stats(d, prep.stratified_sample(d, ["month", "primary_category"], 3))


@query(
    """SELECT count(*) AS total_raw_records, count(DISTINCT doc_id) AS total_unique_papers, strftime(min(CASE WHEN doc_id % 97 <> 0 THEN CAST(month || '-15' AS DATE) END), '%Y-%m-%d') AS start_date, strftime(max(CASE WHEN doc_id % 97 <> 0 THEN CAST(month || '-15' AS DATE) END), '%Y-%m-%d') AS end_date,
count(*) FILTER (WHERE length(abstract) >= 300) AS total_clean_papers, (SELECT count(*) FROM sampled) AS total_sampled_papers FROM docs""",
    V.DOCS,
    _SAMPLED,
)
def d4_dataset_stats(spark, sf):
    d = prep.with_dates(V.docs(spark, sf).drop("month")).drop("month").join(V.docs(spark, sf).select("doc_id", "month"), "doc_id")
    return prep.dataset_stats(d, prep.min_chars(d, 300, "abstract"), prep.stratified_sample(d, ["month", "primary_category"], 3))


@query(
    r"""WITH t AS (SELECT *, CASE WHEN month BETWEEN '2023-01' AND '2023-12' THEN 'T1_fine' WHEN month BETWEEN '2022-01' AND '2022-12' THEN 'T2_medium' WHEN month BETWEEN '2020-03' AND '2020-11' THEN 'T4_historic' END AS t2 FROM keyed WHERE primary_category IN ('c0', 'c1', 'c3')
  AND NOT contains(lower(coalesce(title, '')), 'withdrawn') AND NOT contains(lower(coalesce(abstract, '')), 'withdrawn'))
SELECT doc_id, t2 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY t2, tk ORDER BY month DESC, doc_id) AS n FROM t WHERE t2 IS NOT NULL) WHERE n = 1""",
    V.DOCS,
    _TITLES,
)
def d5_tier_loader(spark, sf):
    return prep.prepare_tiers(V.docs(spark, sf).drop("tier"), DOC_TIERS, ["c0", "c1", "c3"]).select("doc_id", "tier")


@query("SELECT doc_id, month, primary_category FROM sampled", V.DOCS, _SAMPLED)
def t6_stratified_sample(spark, sf):
    return prep.stratified_sample(V.docs(spark, sf), ["month", "primary_category"], 3).select("doc_id", "month", "primary_category")


@query(
    """WITH d AS (SELECT *, doc_id % 7 AS cluster FROM docs), s AS (SELECT year, primary_category, cluster, count(*) AS size FROM d GROUP BY ALL),
p AS (SELECT *, sum(size) OVER (PARTITION BY year, primary_category) AS pool FROM s),
q AS (SELECT *, least(greatest(1, floor(20 * size / pool)), size) AS quota FROM p),
j AS (SELECT d.doc_id, q.*, md5('42:' || d.doc_id) AS o FROM d JOIN q ON d.year = q.year AND d.primary_category = q.primary_category AND d.cluster = q.cluster),
r AS (SELECT *, row_number() OVER (PARTITION BY year, primary_category, cluster ORDER BY o, doc_id) AS i FROM j),
c AS (SELECT *, row_number() OVER (PARTITION BY year, primary_category ORDER BY o, doc_id) AS k FROM r WHERE pool <= 20 OR NOT (pool >= 40 AND pool >= 50) OR i <= quota)
SELECT doc_id, year, primary_category, CAST(cluster AS BIGINT) AS cluster FROM c WHERE pool <= 20 OR k <= 20""",
    V.DOCS,
)
def t4_diversity_sample(spark, sf):
    d = V.docs(spark, sf).withColumn("cluster", F.col("doc_id") % 7)
    return prep.diversity_sample(d, ["year", "primary_category"], "cluster", 20, min_pool=50).select("doc_id", "year", "primary_category", "cluster")


_WORDS = rf"""words AS (SELECT doc_id, year, primary_category, list_filter(regexp_extract_all(lower(coalesce(abstract, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([{', '.join(repr(w) for w in V.STOP)}], w)) AS w FROM docs),
terms AS (SELECT doc_id, year, primary_category, term, count(*) AS tf FROM (SELECT doc_id, year, primary_category, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words) GROUP BY ALL),
known AS (SELECT year, primary_category, term, df FROM (SELECT *, row_number() OVER (PARTITION BY year, primary_category ORDER BY total DESC, term) AS r FROM (SELECT year, primary_category, term, sum(tf) AS total, count(*) AS df FROM terms GROUP BY ALL)) WHERE r <= 2000),
pools AS (SELECT year, primary_category, count(*) AS n FROM docs GROUP BY ALL),
x AS MATERIALIZED (SELECT doc_id, year, primary_category, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM (SELECT doc_id, year, primary_category, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM terms JOIN known USING (year, primary_category, term) JOIN pools USING (year, primary_category)))"""


def _lloyd(k: int, rounds: int) -> str:
    """Rounds of assignment in each group, one after the other."""
    parts = [f"m0 AS (SELECT * FROM (SELECT doc_id, year, primary_category, row_number() OVER (PARTITION BY year, primary_category ORDER BY md5('42:' || doc_id), doc_id) - 1 AS cluster FROM docs) WHERE cluster < {k})"]
    for r in range(1, rounds + 1):
        kept = f" UNION ALL SELECT * FROM c{r - 1} ANTI JOIN m{r - 1} USING (year, primary_category, cluster)" if r > 1 else ""
        parts.append(f"c{r} AS MATERIALIZED (SELECT year, primary_category, cluster, term, sum(x) / any_value(m) AS x FROM x JOIN m{r - 1} USING (doc_id, year, primary_category) JOIN (SELECT year, primary_category, cluster, count(*) AS m FROM m{r - 1} GROUP BY ALL) USING (year, primary_category, cluster) GROUP BY ALL{kept})".replace("any_value(m)", "max(m)").replace("GROUP BY ALL UNION", "GROUP BY year, primary_category, cluster, term UNION"))
        parts.append(
            f"m{r} AS MATERIALIZED (SELECT doc_id, year, primary_category, coalesce(near.cluster, 0) AS cluster FROM docs LEFT JOIN (SELECT doc_id, arg_min(cluster, (gap, cluster)) AS cluster FROM (SELECT doc_id, d.cluster, round(max(c2) - 2 * sum(d.x * coalesce(c.x, 0)), 9) AS gap"
            f" FROM (SELECT * FROM x JOIN (SELECT year, primary_category, cluster, sum(x * x) AS c2 FROM c{r} GROUP BY ALL) USING (year, primary_category)) d LEFT JOIN c{r} c ON c.year = d.year AND c.primary_category = d.primary_category AND c.cluster = d.cluster AND c.term = d.term GROUP BY 1, 2) GROUP BY 1) near USING (doc_id))"
        )
    return ",\n".join(parts)


_CLUSTERED = f"{_WORDS},\n{_lloyd(4, 5)}"


@query("SELECT doc_id, year, primary_category, CAST(cluster AS INTEGER) AS cluster FROM m5", V.DOCS, _CLUSTERED)
def t5_micro_clusters(spark, sf):
    d = V.docs(spark, sf).select("doc_id", "year", "primary_category", "abstract")
    return sampling.micro_clusters(d, ["year", "primary_category"], F.col("abstract"), 4, V.STOP).select("doc_id", "year", "primary_category", "cluster")


@query(
    """WITH s AS (SELECT year, primary_category, cluster, count(*) AS size FROM m5 GROUP BY ALL), p AS (SELECT *, sum(size) OVER (PARTITION BY year, primary_category) AS pool FROM s),
q AS (SELECT *, least(greatest(1, floor(20 * size / pool)), size) AS quota FROM p), j AS (SELECT *, md5('42:' || doc_id) AS o FROM m5 JOIN q USING (year, primary_category, cluster)),
r AS (SELECT *, row_number() OVER (PARTITION BY year, primary_category, cluster ORDER BY o, doc_id) AS i FROM j),
c AS (SELECT *, row_number() OVER (PARTITION BY year, primary_category ORDER BY o, doc_id) AS k FROM r WHERE pool <= 20 OR NOT (pool >= 40 AND pool >= 50) OR i <= quota)
SELECT doc_id, year, primary_category FROM c WHERE pool <= 20 OR k <= 20""",
    V.DOCS, _CLUSTERED,
)
def t3_semantic_sample(spark, sf):
    d = V.docs(spark, sf).select("doc_id", "year", "primary_category", "abstract")
    return sampling.semantic_sample(d, ["year", "primary_category"], F.col("abstract"), 20, V.STOP, min_pool=50).select("doc_id", "year", "primary_category")


# --- vocabulary and topics ----------------------------------------------------------------------------------------

_TOKENS = rf"tokens AS (SELECT doc_id, year, query_category, primary_category, unnest(list_filter(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([{', '.join(repr(w) for w in V.STOP)}], w))) AS term FROM docs)"
_SETS = """
sizes AS (SELECT year, query_category, count(*) AS n, sum(count(*)) OVER (PARTITION BY year) AS y FROM docs GROUP BY 1, 2),
good AS (SELECT year, query_category FROM sizes WHERE y >= 100 AND n >= 50),
tops AS (SELECT *, row_number() OVER (PARTITION BY year, query_category ORDER BY n DESC, term) AS r FROM (SELECT year, query_category, term, count(*) AS n FROM tokens SEMI JOIN good USING (year, query_category) GROUP BY ALL)),
sets AS (SELECT year, query_category AS category, list(term) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY year, query_category ORDER BY term) AS k FROM tops WHERE r <= 100) WHERE k <= 50 GROUP BY ALL)"""
_JACCARD = "round_even(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))), 4)"
_CONVERGENCE = f"conv AS (SELECT a.year, a.category AS cat1, b.category AS cat2, {_JACCARD.format(a='a.terms', b='b.terms')} AS jaccard FROM sets a JOIN sets b ON a.year = b.year AND a.category < b.category)"


def _text():
    return S.analysis_text(F.col("title"), F.col("abstract"))


def _sets(spark, sf):
    return advanced.term_sets(V.docs(spark, sf), _text(), V.CATEGORIES, V.STOP)


@query(
    """SELECT query_category, term, n FROM (SELECT *, row_number() OVER (PARTITION BY query_category ORDER BY term) AS k FROM
  (SELECT *, row_number() OVER (PARTITION BY query_category ORDER BY n DESC, term) AS r FROM (SELECT query_category, term, count(*) AS n FROM tokens GROUP BY ALL)) WHERE r <= 100) WHERE k <= 50""",
    V.DOCS,
    _TOKENS,
)
def t1_top_terms(spark, sf):
    return topics.top_terms(V.docs(spark, sf), ["query_category"], _text(), V.STOP)


@query("SELECT * FROM kw", V.DOCS, V.KEYWORDS)
def t11_ctfidf(spark, sf):
    return V.keywords(spark, sf)


@query("SELECT * FROM signed", V.DOCS, V.INFO, V.KEYWORDS, V.SIGNATURES)
def m1_signatures(spark, sf):
    return V.signatures(spark, sf)


@query(
    """WITH w AS (SELECT macro_id, w, count(*) AS n FROM (SELECT topic_id % 6 AS macro_id, unnest(string_split(keywords_str, ' ')) AS w FROM signed) WHERE w <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY macro_id ORDER BY n DESC, w) AS r FROM w),
l AS (SELECT macro_id, list(w ORDER BY r)[1:8] AS words FROM r WHERE r <= 30 AND w NOT IN ('model', 'models', 'learning', 'data', 'using', 'based', 'method', 'approach', 'new', 'via', 'training', 'paper', 'performance', 'results', 'show', 'propose', 'methods', 'task', 'tasks', 'large') GROUP BY 1),
s AS (SELECT topic_id % 6 AS macro_id, count(*) AS n_topics, CAST(sum(paper_count) AS BIGINT) AS total_papers FROM signed GROUP BY 1)
SELECT macro_id, n_topics, total_papers, array_to_string(list_transform(words[1:3], lambda x: upper(x[1]) || lower(x[2:])), ' + ') AS label, array_to_string(words[1:5], ', ') AS keywords FROM s LEFT JOIN l USING (macro_id)""",
    V.DOCS, V.INFO, V.KEYWORDS, V.SIGNATURES,
)
def m2_macro_labels(spark, sf):
    signed = V.signatures(spark, sf)
    return topics.macro_labels(signed, signed.select("tier", "topic_id", (F.col("topic_id") % V.N_MACRO).alias("macro_id")))


@query(
    """WITH words AS (SELECT doc_id, topic_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(abstract, '')), '[\\s\\x0B]+'), lambda w: w <> ''))) AS w FROM docs),
big AS (SELECT topic_id FROM docs WHERE topic_id <> -1 GROUP BY 1 HAVING count(*) >= 5),
best AS (SELECT * FROM (SELECT topic_id, w, row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, w) AS r FROM words SEMI JOIN big USING (topic_id) WHERE w NOT IN (%s) GROUP BY 1, 2) WHERE r <= 10),
known AS (SELECT doc_id, w FROM words SEMI JOIN best USING (w)), single AS (SELECT w, count(*) AS c FROM known GROUP BY 1),
pairs AS (SELECT a.topic_id, a.w AS w1, b.w AS w2 FROM best a JOIN best b ON a.topic_id = b.topic_id AND a.r < b.r),
joint AS (SELECT a.w AS w1, b.w AS w2, count(*) AS c FROM known a JOIN known b USING (doc_id) SEMI JOIN pairs p ON p.w1 = a.w AND p.w2 = b.w GROUP BY 1, 2),
f AS (SELECT pairs.*, greatest(coalesce(joint.c, 0) / n, 1e-12) AS p12, greatest(s1.c / n, 1e-12) AS p1, greatest(s2.c / n, 1e-12) AS p2
  FROM pairs LEFT JOIN joint USING (w1, w2) JOIN single s1 ON s1.w = w1 JOIN single s2 ON s2.w = w2, (SELECT count(*) AS n FROM docs))
SELECT round_even(avg(CASE WHEN p12 >= 1 THEN 1.0 ELSE greatest(-1.0, least(1.0, ln(p12 / (p1 * p2)) / -ln(p12))) END), 6) AS npmi, count(DISTINCT topic_id) AS n_topics, count(*) AS n_pairs FROM f"""
    % ", ".join(f"'{w}'" for w in topics.COHERENCE_STOP),
    V.DOCS,
)
def t14_npmi(spark, sf):
    return topics.coherence(V.docs(spark, sf), F.col("abstract"))


@query(
    """WITH i AS (SELECT *, paper_count / sum(paper_count) OVER (PARTITION BY tier) AS w FROM info WHERE topic_id <> -1),
k AS (SELECT tier, keyword, sum(w) AS w FROM kw JOIN i USING (tier, topic_id) WHERE rank <= 5 GROUP BY ALL), p AS (SELECT *, w / sum(w) OVER (PARTITION BY tier) AS p FROM k),
h AS (SELECT tier, count(*) AS n_unique_keywords, -sum(p * log2(p)) AS h FROM p GROUP BY 1)
SELECT tier, (SELECT count(*) FROM i WHERE i.tier = h.tier) AS n_topics, n_unique_keywords, round_even(h, 3) AS shannon_entropy, round_even(CASE WHEN n_unique_keywords > 1 THEN h / log2(n_unique_keywords) ELSE 0.0 END, 4) AS evenness FROM h""",
    V.DOCS, V.INFO, V.KEYWORDS,
)
def v2_diversity_entropy(spark, sf):
    return topics.diversity_entropy(V.keywords(spark, sf), V.info(spark, sf))


# --- advanced -----------------------------------------------------------------------------------------------------


def _has(terms):
    return " OR ".join(f"contains(t, '{x}')" for x in terms)


@query(
    "WITH t AS (SELECT year, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS t FROM docs), y AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS paradigm, year, count(*) FILTER (WHERE {_has(v)}) AS hits, count(*) AS n FROM t GROUP BY year" for k, v in V.PARADIGMS.items())
    + """), r AS (SELECT *, hits / n AS ratio FROM y WHERE hits > 0),
a AS (SELECT paradigm, min(year) FILTER (WHERE ratio > 0.001) AS first_year, max(ratio) AS peak, coalesce(max(ratio) FILTER (WHERE year = 2023), 0.0) AS now FROM r GROUP BY 1)
SELECT paradigm, first_year, peak_year, peak_year - first_year AS time_to_peak_years, round_even(peak, 4) AS peak_ratio, round_even(now, 4) AS current_ratio, CASE WHEN now > 0.8 * peak THEN 'growing' WHEN now < 0.3 * peak THEN 'declining' ELSE 'plateau' END AS status
FROM a JOIN (SELECT paradigm, min(year) AS peak_year FROM r JOIN a USING (paradigm) WHERE ratio = peak GROUP BY 1) USING (paradigm)""",
    V.DOCS,
)
def v1_paradigm_halflife(spark, sf):
    return advanced.paradigm_halflife(V.docs(spark, sf), _text(), V.PARADIGMS, 2023)


@query("SELECT * FROM conv", V.DOCS, _TOKENS, _SETS, _CONVERGENCE)
def v3_convergence(spark, sf):
    return advanced.convergence(V.docs(spark, sf), _text(), V.CATEGORIES, V.STOP)


@query(
    """WITH y AS (SELECT year, avg(jaccard) AS j FROM conv GROUP BY 1), a AS (SELECT avg(j) FILTER (WHERE year <= 2021) AS early, avg(j) FILTER (WHERE year >= 2022) AS late FROM y)
SELECT round_even(early, 6) AS early, round_even(late, 6) AS late, CASE WHEN early IS NULL OR late IS NULL THEN NULL WHEN late > early THEN 'converging' ELSE 'diverging' END AS trend FROM a""",
    V.DOCS, _TOKENS, _SETS, _CONVERGENCE,
)
def v4_trend(spark, sf):
    return advanced.convergence_trend(v3_convergence(spark, sf), 2021, 2022)


_LIFE = """life AS (SELECT *, CASE WHEN n_topics < 5 THEN 'niche' WHEN tier_2023_2026 > tier_1998_2016 * 2 THEN 'growing' WHEN tier_1998_2016 > tier_2023_2026 THEN 'declining' ELSE 'mature' END AS lifecycle_stage FROM
  (SELECT macro_id, count(*) AS n_topics, CAST(sum(paper_count) AS BIGINT) AS total_papers, count(*) FILTER (WHERE tier_label = '2023-2026') AS tier_2023_2026, count(*) FILTER (WHERE tier_label = '2020-2023') AS tier_2020_2023,
    count(*) FILTER (WHERE tier_label = '2016-2020') AS tier_2016_2020, count(*) FILTER (WHERE tier_label = '1998-2016') AS tier_1998_2016 FROM macro GROUP BY 1))"""


@query("SELECT * FROM life", V.DOCS, V.INFO, V.MACRO_PLAIN, _LIFE)
def v5_lifecycle(spark, sf):
    return advanced.lifecycle(V.macro_plain(spark, sf), V.LABELS)


_RATES = "t AS (SELECT month, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS t FROM docs), rates AS (" + " UNION ALL ".join(f"SELECT '{x}' AS term, month, 1000.0 * count(*) FILTER (WHERE contains(t, '{x}')) / count(*) AS rate FROM t GROUP BY month" for x in V.TERMS) + ")"
_BURSTS = """
hot AS (SELECT *, avg(rate) OVER w AS base, rate > avg(rate) OVER w + 1.0 * stddev_pop(rate) OVER w AS hot, lead(month) OVER o AS nx, count(*) OVER w AS k FROM rates WINDOW w AS (PARTITION BY term), o AS (PARTITION BY term ORDER BY month)),
isl AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY month) - row_number() OVER (PARTITION BY term, hot ORDER BY month) AS run FROM hot WHERE k >= 24),
runs AS (SELECT term, run, min(month) AS start, arg_max(nx, month) AS "end", max(round_even(rate, 9)) AS pk, any_value(base) AS base FROM isl WHERE hot GROUP BY 1, 2),
bursts AS (SELECT * FROM (SELECT term, start, "end", (SELECT min(month) FROM isl i WHERE i.term = r.term AND i.run = r.run AND i.hot AND round_even(i.rate, 9) = r.pk) AS peak, round_even(pk, 2) AS peak_rate,
  CAST(datediff('day', CAST(start || '-01' AS DATE), CAST("end" || '-01' AS DATE)) // 30 AS INTEGER) AS duration_months, round_even(base, 2) AS baseline_rate FROM runs r WHERE "end" IS NOT NULL) WHERE duration_months >= 1)"""


def _bursts(spark, sf):
    return advanced.bursts(advanced.term_rates(V.docs(spark, sf), _text(), V.TERMS), 1.0, min_spans=1)


@query("SELECT * FROM bursts", V.DOCS, _RATES, _BURSTS)
def v6_bursts(spark, sf):
    return _bursts(spark, sf)


# --- final --------------------------------------------------------------------------------------------------------

UMBRELLA = ("that", "this", "ntwhich", "thing", "eaux", "schaft", "an")


@query(
    "WITH f AS (SELECT *, list_filter(terms, lambda t: NOT (list_contains(["
    + ", ".join(f"'{u}'" for u in UMBRELLA)
    + "], t) OR "
    + " OR ".join(f"contains(t, '{u}')" for u in UMBRELLA if len(u) > 5)
    + ")) AS kept FROM sets) SELECT a.year, a.category AS cat1, b.category AS cat2, "
    + _JACCARD.format(a="a.terms", b="b.terms")
    + " AS jaccard_raw, "
    + _JACCARD.format(a="a.kept", b="b.kept")
    + " AS jaccard_filtered, round_even(jaccard_raw - jaccard_filtered, 4) AS umbrella_effect FROM f a JOIN f b ON a.year = b.year AND a.category < b.category",
    V.DOCS,
    _TOKENS,
    _SETS,
)
def r1_umbrella_jaccard(spark, sf):
    return final.umbrella_overlap(_sets(spark, sf), V.CATEGORIES, UMBRELLA)


_PARTS = """parts AS (SELECT tier, macro_id, papers, proportion, round_even(c, 6) AS entropy_contrib, round_even(c * 100 / sum(c) OVER (PARTITION BY tier), 1) AS entropy_pct FROM
  (SELECT *, -proportion * ln(proportion + 1e-10) AS c FROM (SELECT tier, macro_id, CAST(sum(paper_count) AS BIGINT) AS papers, round_even(sum(paper_count) / sum(sum(paper_count)) OVER (PARTITION BY tier), 6) AS proportion FROM macro GROUP BY 1, 2)))"""


@query("SELECT * FROM parts", V.DOCS, V.INFO, V.MACRO_PLAIN, _PARTS)
def r2_entropy_decomp(spark, sf):
    return final.entropy_decomposition(V.macro_plain(spark, sf))


@query(
    """WITH d AS (SELECT macro_id, round_even(coalesce(b.entropy_contrib, 0) - coalesce(a.entropy_contrib, 0), 6) AS delta FROM (SELECT * FROM parts WHERE tier = 'T1_fine') b FULL JOIN (SELECT * FROM parts WHERE tier = 'T2_medium') a USING (macro_id)),
r AS (SELECT *, row_number() OVER (ORDER BY delta DESC, macro_id) AS up, row_number() OVER (ORDER BY delta, macro_id) AS down FROM d)
SELECT macro_id, delta, CASE WHEN up <= 3 THEN 'top' ELSE 'bottom' END AS side FROM r WHERE up <= 3 OR down <= 3""",
    V.DOCS, V.INFO, V.MACRO_PLAIN, _PARTS,
)
def r3_entropy_delta(spark, sf):
    return final.entropy_changes(r2_entropy_decomp(spark, sf), "T2_medium", "T1_fine")


@query("SELECT year, round_even(avg(k), 6) AS avg_categories, round_even(stddev_samp(k), 6) AS std_categories FROM (SELECT year, len(string_split(categories, '|')) AS k FROM docs) GROUP BY 1", V.DOCS)
def r4_multi_category(spark, sf):
    return final.multi_category_trend(V.docs(spark, sf))


@query(
    f"""WITH own AS (SELECT * FROM docs WHERE primary_category = query_category),
sizes AS (SELECT year, query_category, count(*) AS n, sum(count(*)) OVER (PARTITION BY year) AS y FROM own GROUP BY 1, 2),
good AS (SELECT year, query_category FROM sizes WHERE y >= 100 AND n >= 30),
tops AS (SELECT *, row_number() OVER (PARTITION BY year, query_category ORDER BY n DESC, term) AS r FROM (SELECT year, query_category, term, count(*) AS n FROM tokens SEMI JOIN good USING (year, query_category) WHERE primary_category = query_category GROUP BY ALL)),
sets AS (SELECT year, query_category AS category, list(term) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY year, query_category ORDER BY term) AS k FROM tops WHERE r <= 100) WHERE k <= 50 GROUP BY ALL)
SELECT a.year, a.category AS cat1, b.category AS cat2, {_JACCARD.format(a='a.terms', b='b.terms')} AS jaccard_primary_only FROM sets a JOIN sets b ON a.year = b.year AND a.category < b.category""",
    V.DOCS,
    _TOKENS,
)
def r5_primary_jaccard(spark, sf):
    own = V.docs(spark, sf).where("primary_category = query_category")
    sets = advanced.term_sets(own, _text(), V.CATEGORIES, V.STOP, min_category=30)
    return advanced.pair_overlap(sets, V.CATEGORIES, name="jaccard_primary_only")


@query(
    """WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY start) AS n FROM bursts) WHERE n = 1),
h AS (SELECT b.*, macro.tier, macro_id, row_number() OVER (PARTITION BY term, macro.tier ORDER BY topic_id) AS k FROM b JOIN freq ON freq.keyword = b.term JOIN macro ON macro.tier = freq.tier AND contains(top5_kw, b.term))
SELECT term, tier, h.macro_id, lifecycle_stage AS lifecycle, start AS burst_start, peak AS burst_peak, duration_months AS burst_duration FROM h LEFT JOIN life USING (macro_id) WHERE k = 1""",
    V.DOCS, V.INFO, V.KEYWORDS, V.SIGNATURES, _FREQUENCY, V.MACRO, _LIFE, _RATES.replace("'the'", "'that'"), _BURSTS,
)
def r6_burst_lifecycle(spark, sf):
    terms = [*V.TERMS[:-1], "that"]
    found = advanced.bursts(advanced.term_rates(V.docs(spark, sf), _text(), terms), 1.0, min_spans=1)
    macro = V.macro(spark, sf)
    return final.burst_lifecycles(found, topics.keyword_frequency(V.signatures(spark, sf)), macro, advanced.lifecycle(macro, V.LABELS))


def _control(spark, sf):
    wide = growth.wide(V.months(spark, sf), V.PRIORITIES).select("month", *[F.col(f"`{c}`").alias(n) for c, n in zip(V.PRIORITIES, V.SHORT)])
    return final.synthetic_control(wide, "p1", V.SHORT[1:4], PRE)


#: Weights of three donors on the simplex: every active set in closed form, the best feasible one.
_CONTROL = f"""
pre AS (SELECT sum(p2 * p2) AS a, sum(p3 * p3) AS b, sum(p4 * p4) AS c, sum(p2 * p3) AS ab, sum(p2 * p4) AS ac, sum(p3 * p4) AS bc, sum(p1 * p2) AS ta, sum(p1 * p3) AS tb, sum(p1 * p4) AS tc FROM (SELECT month, CAST(p1 AS DOUBLE) AS p1, CAST(p2 AS DOUBLE) AS p2, CAST(p3 AS DOUBLE) AS p3, CAST(p4 AS DOUBLE) AS p4 FROM wide) WHERE month BETWEEN '{PRE[0]}' AND '{PRE[1]}'),
three AS (SELECT *, a - 2 * ac + c AS e, ab - ac - bc + c AS f, b - 2 * bc + c AS g, ta - tc - ac + c AS u, tb - tc - bc + c AS v FROM pre),
sets AS (SELECT 1.0 AS x, 0.0 AS y, 0.0 AS z UNION ALL SELECT 0.0, 1.0, 0.0 UNION ALL SELECT 0.0, 0.0, 1.0
  UNION ALL SELECT (b - ab + ta - tb) / (a + b - 2 * ab), (a - ab + tb - ta) / (a + b - 2 * ab), 0.0 FROM pre UNION ALL SELECT (c - ac + ta - tc) / (a + c - 2 * ac), 0.0, (a - ac + tc - ta) / (a + c - 2 * ac) FROM pre
  UNION ALL SELECT 0.0, (c - bc + tb - tc) / (b + c - 2 * bc), (b - bc + tc - tb) / (b + c - 2 * bc) FROM pre
  UNION ALL SELECT (u * g - v * f) / (e * g - f * f), (v * e - u * f) / (e * g - f * f), 1 - (u * g - v * f + v * e - u * f) / (e * g - f * f) FROM three),
w AS (SELECT x, y, z FROM sets, pre WHERE least(x, y, z) >= -1e-10 ORDER BY x * x * a + y * y * b + z * z * c + 2 * (x * y * ab + x * z * ac + y * z * bc) - 2 * (x * ta + y * tb + z * tc) LIMIT 1),
control AS (SELECT month, CAST(p1 AS DOUBLE) AS actual, x * p2 + y * p3 + z * p4 AS synthetic, p1 - (x * p2 + y * p3 + z * p4) AS gap FROM wide, w)"""


@query("SELECT month, actual, round_even(synthetic, 5) AS synthetic, round_even(gap, 5) AS gap FROM control", V.MONTHS, _WIDE, _CONTROL)
def r7_synthetic_control(spark, sf):
    return _control(spark, sf).withColumns({c: F.bround(c, 5) for c in ("synthetic", "gap")})


@query(
    f"SELECT round_even(avg(gap * gap) FILTER (WHERE month BETWEEN '{PRE[0]}' AND '{PRE[1]}'), 4) AS pre_mse, round_even(avg(gap) FILTER (WHERE month BETWEEN '{POST[0]}' AND '{POST[1]}'), 4) AS mean_gap, round_even(sum(gap) FILTER (WHERE month BETWEEN '{POST[0]}' AND '{POST[1]}'), 4) AS cumulative_gap FROM control",
    V.MONTHS, _WIDE, _CONTROL,
)
def r7_control_summary(spark, sf):
    return final.control_summary(_control(spark, sf), PRE, POST).select(*[F.bround(c, 4).alias(c) for c in ("pre_mse", "mean_gap", "cumulative_gap")])


#: Quarterly growth of log counts; cross products of a pair's lags; elimination of their table leaves the sums of squared rests.
_QUARTERS = """q AS (SELECT category, substr(month, 1, 4) || 'Q' || ((CAST(substr(month, 6, 2) AS INTEGER) + 2) // 3) AS quarter, sum(count) AS n FROM months GROUP BY ALL),
growth AS (SELECT * FROM (SELECT category, quarter, ln(1 + n) - lag(ln(1 + n)) OVER (PARTITION BY category ORDER BY quarter) AS g FROM q) WHERE g IS NOT NULL)"""
_GRANGER = """
pair AS (SELECT a.category AS cause, b.category AS effect, quarter, a.g AS x, b.g AS y FROM growth a JOIN growth b USING (quarter) WHERE a.category <> b.category),
lags AS (SELECT cause, effect, row_number() OVER o AS i, [1.0, lag(y, 1) OVER o, lag(y, 2) OVER o, lag(y, 3) OVER o, lag(y, 4) OVER o, lag(x, 1) OVER o, lag(x, 2) OVER o, lag(x, 3) OVER o, lag(x, 4) OVER o, y] AS v FROM pair WINDOW o AS (PARTITION BY cause, effect ORDER BY quarter)),
cells AS (SELECT cause, effect, a, b, count(*) AS n, sum(v[a] * v[b]) AS s FROM (SELECT cause, effect, v, a, unnest(range(1, 11)) AS b FROM (SELECT cause, effect, v, unnest(range(1, 11)) AS a FROM lags WHERE i > 4)) GROUP BY ALL),
tables AS (SELECT cause, effect, any_value(n) AS n, list(r ORDER BY a) AS m FROM (SELECT cause, effect, a, any_value(n) AS n, list(s ORDER BY b) AS r FROM cells GROUP BY ALL) GROUP BY 1, 2),
swept AS (SELECT cause, effect, n, m, 0 AS k FROM tables UNION ALL SELECT cause, effect, n, list_transform(m, lambda r, i: CASE WHEN i <= k + 1 THEN r ELSE list_transform(r, lambda x, j: x - r[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END), k + 1 FROM swept WHERE k < 9),
rests AS (SELECT cause, effect, any_value(n) - 9 AS df, max(m[10][10]) FILTER (WHERE k = 5) AS small, max(m[10][10]) FILTER (WHERE k = 9) AS large FROM swept GROUP BY 1, 2),
f AS (SELECT *, (small - large) / 4 / (large / df) AS f FROM rests),
p AS (SELECT *, pow(1 - x, df / 2) * (1 + df / 2 * x) AS p FROM (SELECT *, 4 * f / (4 * f + df) AS x FROM f)),
o AS (SELECT *, row_number() OVER (ORDER BY p DESC, cause, effect) AS k, count(*) OVER () AS n FROM p)
SELECT cause, effect, round_even(f, 3) AS f_statistic, round_even(p, 4) AS p_value, p < 0.05 AS significant, round_even(least(1.0, min(p * n / (n - k + 1)) OVER (ORDER BY k)), 4) AS p_adjusted FROM o"""


@query("WITH" + _GRANGER, V.MONTHS, _QUARTERS)
def r8_granger(spark, sf):
    return final.granger_tests(final.quarterly_growth(V.months(spark, sf)))


@query(
    """WITH q AS (SELECT category, substr(month, 1, 4) || 'Q' || ((CAST(substr(month, 6, 2) AS INTEGER) + 2) // 3) AS quarter, sum(count) AS n FROM months GROUP BY ALL),
g AS (SELECT category, quarter, ln(1 + n) - lag(ln(1 + n)) OVER (PARTITION BY category ORDER BY quarter) AS g FROM q)
SELECT category, quarter, round_even(g, 6) AS g FROM g WHERE g IS NOT NULL""",
    V.MONTHS,
)
def r8_quarterly_growth(spark, sf):
    return final.quarterly_growth(V.months(spark, sf)).withColumn("g", F.bround("g", 6))


@query(
    """WITH n(tier, k) AS (VALUES ('T4_historic', 0.0), ('T3_coarse', 1.0), ('T2_medium', 2.0), ('T1_fine', 3.0)), c AS (SELECT topic_id, min_by(tier, k) AS cohort FROM macro JOIN n USING (tier) GROUP BY 1),
r AS (SELECT ln(1 + paper_count) AS y, CAST(n.k AS DOUBLE) AS a, CAST(o.k AS DOUBLE) AS c FROM macro JOIN c USING (topic_id) JOIN n USING (tier) JOIN n o ON o.tier = cohort),
s AS (SELECT count(*) AS n, avg(a) AS ma, avg(c) AS mc, avg(y) AS my, covar_pop(a, a) AS aa, covar_pop(c, c) AS cc, covar_pop(a, c) AS ac, covar_pop(a, y) AS ay, covar_pop(c, y) AS cy, covar_pop(y, y) AS yy FROM r),
d AS (SELECT *, aa * cc - ac * ac AS det FROM s),
b AS (SELECT *, CASE WHEN det > 1e-9 THEN (ay * cc - cy * ac) / det WHEN aa > 0 AND cc < 1e-9 THEN ay / aa ELSE 0.0 END AS ba, CASE WHEN det > 1e-9 THEN (cy * aa - ay * ac) / det WHEN cc > 0 AND aa < 1e-9 THEN cy / cc ELSE 0.0 END AS bc FROM d),
v AS (SELECT unnest(['age', 'period', 'cohort_num', 'intercept', 'r_squared']) AS variable, unnest([ba / 2, ba / 2, bc, my - ba * ma - bc * mc, CASE WHEN yy > 0 THEN (ba * ay + bc * cy) / yy ELSE 0.0 END]) AS coefficient FROM b)
SELECT variable, round_even(coefficient, 6) AS coefficient FROM v""",
    V.DOCS, V.INFO, V.MACRO_PLAIN,
)
def r9_apc(spark, sf):
    """Cohorts by the first tier in time: two regressors that differ."""
    return final.apc_coefficients(final.age_period_cohort(V.macro_plain(spark, sf), V.TIERS, by_first_tier=True)).withColumn("coefficient", F.bround("coefficient", 6))


@query(
    """WITH n(tier, k) AS (VALUES ('T4_historic', 0.0), ('T3_coarse', 1.0), ('T2_medium', 2.0), ('T1_fine', 3.0)), c AS (SELECT topic_id, min(tier) AS cohort FROM macro GROUP BY 1)
SELECT tier, topic_id, round_even(ln(1 + paper_count), 6) AS y, CAST(n.k AS DOUBLE) AS age, CAST(n.k AS DOUBLE) AS period, CAST(o.k AS DOUBLE) AS cohort_num FROM macro JOIN c USING (topic_id) JOIN n USING (tier) JOIN n o ON o.tier = cohort""",
    V.DOCS, V.INFO, V.MACRO_PLAIN,
)
def r9_apc_data(spark, sf):
    return final.age_period_cohort(V.macro_plain(spark, sf), V.TIERS).withColumn("y", F.bround("y", 6))


_BRIDGE = """bridge AS (SELECT m.macro_id, t.tier, coalesce(n, 0) AS n_topics, CAST(coalesce(p, 0) AS BIGINT) AS total_papers, CAST(coalesce(n * p, 0) AS BIGINT) AS bridge_score FROM (SELECT DISTINCT macro_id FROM macro) m
  CROSS JOIN (SELECT unnest(['T1_fine', 'T2_medium', 'T3_coarse', 'T4_historic']) AS tier) t LEFT JOIN (SELECT macro_id, tier, count(*) AS n, sum(paper_count) AS p FROM macro GROUP BY 1, 2) s ON s.macro_id = m.macro_id AND s.tier = t.tier)"""


@query("SELECT * FROM bridge", V.DOCS, V.INFO, V.MACRO_PLAIN, _BRIDGE)
def r10_bridge(spark, sf):
    return final.bridge_topics(V.macro_plain(spark, sf), V.TIERS)


@query("SELECT macro_id, tier, n_topics, total_papers, bridge_score FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY bridge_score DESC, macro_id) AS n FROM bridge) WHERE n <= 3", V.DOCS, V.INFO, V.MACRO_PLAIN, _BRIDGE)
def r10_top_bridges(spark, sf):
    return final.top_bridges(final.bridge_topics(V.macro_plain(spark, sf), V.TIERS))


# --- experiments and models ---------------------------------------------------------------------------------------

_ENTROPY = """ent AS (SELECT tier, count(*) AS n_topics, round_even(-sum(p * log2(p)), 6) AS entropy, round_even(pow(2, -sum(p * log2(p))), 4) AS effective_number, round_even(1 - sum(n) / max(whole), 6) AS noise_rate
  FROM (SELECT *, n / sum(n) OVER (PARTITION BY tier) AS p FROM (SELECT *, sum(n) OVER (PARTITION BY tier) AS whole FROM (SELECT tier, topic_id, count(*) AS n FROM docs GROUP BY 1, 2)) WHERE topic_id <> -1) GROUP BY 1)"""
_PROPORTIONS = "props AS (SELECT tier, macro_id, round_even(sum(n) / max(whole), 6) AS proportion FROM (SELECT *, sum(n) OVER (PARTITION BY tier) AS whole FROM (SELECT tier, topic_id, count(*) AS n FROM docs GROUP BY 1, 2)) JOIN macro USING (tier, topic_id) GROUP BY 1, 2)"


@query("SELECT * FROM ent", V.DOCS, _ENTROPY)
def e1_entropy(spark, sf):
    return experiments.entropy(experiments.topic_counts(V.docs(spark, sf)))


@query("SELECT * FROM props", V.DOCS, V.INFO, V.MACRO_PLAIN, _PROPORTIONS)
def e2_macro_props(spark, sf):
    return experiments.macro_proportions(experiments.topic_counts(V.docs(spark, sf)), V.macro_plain(spark, sf))


@query(
    "WITH sent AS ("
    + _ENTROPY.removeprefix("ent AS (")[:-1].replace("FROM docs", "FROM sampled")
    + "), sprops AS ("
    + _PROPORTIONS.removeprefix("props AS (")[:-1].replace("FROM docs", "FROM sampled")
    + """),
b AS (SELECT tier, macro_id, coalesce(s.proportion, 0.0) AS sampled, coalesce(f.proportion, 0.0) AS "full", round_even(coalesce(s.proportion, 0.0) - coalesce(f.proportion, 0.0), 6) AS diff FROM sprops s FULL JOIN props f USING (tier, macro_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY abs(diff) DESC, macro_id) AS n FROM b)
SELECT r.tier, macro_id, sampled, "full", diff, round_even(sent.entropy - ent.entropy, 6) AS entropy_delta, round_even((sent.entropy - ent.entropy) * 100 / ent.entropy, 4) AS entropy_bias_pct FROM r JOIN sent ON r.tier = sent.tier JOIN ent ON ent.tier = r.tier WHERE n <= 10""",
    V.DOCS, V.INFO, V.MACRO_PLAIN, _SAMPLED, _ENTROPY, _PROPORTIONS,
)
def e3_compare(spark, sf):
    d = V.docs(spark, sf)
    return experiments.compare(prep.stratified_sample(d, ["month", "primary_category"], 3), d, V.macro_plain(spark, sf))


def _embedded(spark, sf):
    """Documents with a given vector: the embedding whose id is the document's modulo their number."""
    e = table(spark, sf, "embeddings")
    n = e.count()
    return V.docs(spark, sf).withColumn("vec_id", F.col("doc_id") % n).join(e.select("vec_id", "embedding"), "vec_id").drop("vec_id")


@query()
def t10_topic_model(spark, sf):
    e = table(spark, sf, "embeddings")
    assigned = models.assign_topics(models.fit_topics(e, 10), e)
    return assigned.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH parts AS (SELECT label AS topic_id, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL),
means AS (SELECT topic_id, list(x ORDER BY i) AS v, row_number() OVER (ORDER BY topic_id) AS k FROM parts GROUP BY 1),
gaps AS (SELECT a.k, list(CASE WHEN a.k = b.k THEN CAST('inf' AS DOUBLE) ELSE 1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) END ORDER BY b.k) AS g FROM means a, means b GROUP BY 1),
up AS (SELECT list(g ORDER BY k) AS d, list(1.0) AS s, list(k ORDER BY k) AS l, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS todo FROM gaps
  UNION ALL SELECT list_transform(d, lambda r, a: list_transform(r, lambda x, b: CASE WHEN a = j OR b = j OR (a = i AND b = i) THEN CAST('inf' AS DOUBLE) WHEN a = i THEN (s[i] * d[i][b] + s[j] * d[j][b]) / (s[i] + s[j]) WHEN b = i THEN (s[i] * d[i][a] + s[j] * d[j][a]) / (s[i] + s[j]) ELSE x END)),
    list_transform(s, lambda x, a: CASE WHEN a = i THEN s[i] + s[j] ELSE x END), list_transform(l, lambda x: CASE WHEN x = j THEN i ELSE x END), n, todo - 1
  FROM (SELECT *, CAST(pos // n + 1 AS BIGINT) AS i, CAST(pos % n + 1 AS BIGINT) AS j FROM (SELECT *, list_position(flatten(d), list_min(flatten(d))) - 1 AS pos FROM up WHERE todo > 4)))
SELECT 'all' AS tier, topic_id, CAST(len(list_filter(range(1, list_position(l, l[k])), lambda x: list_position(l, l[x]) = x)) AS INTEGER) AS macro_id FROM means, (SELECT l FROM up ORDER BY todo LIMIT 1)"""
)
def t13_macro_cluster(spark, sf):
    e = table(spark, sf, "embeddings").select(F.lit("all").alias("tier"), F.col("label").alias("topic_id"), "embedding")
    return models.macro_clusters(models.mean_vectors(e, ["tier", "topic_id"]), 4)


@query()
def t15_grid(spark, sf):
    e = _embedded(spark, sf).select("doc_id", "abstract", "embedding")
    return models.grid(e, lambda a: topics.coherence(a, F.col("abstract")), (("k5", 5, 5), ("k8", 8, 5), ("k8d8", 8, 8), ("k15", 15, 5)))


@query()
def v5_growth_curves(spark, sf):
    """Logistic curves through the categories' running totals."""
    curves = advanced.growth_curves(V.months(spark, sf))
    return curves.select("category", F.bround("capacity", 1).alias("capacity"), F.bround("midpoint", 2).alias("midpoint"), F.bround("rate", 4).alias("rate"), F.bround("fit", 4).alias("fit"), "stage")


_SPACE = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
gap AS (SELECT a.id AS a, b.id AS b, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM v a JOIN v b ON a.id <> b.id),
core AS (SELECT a AS id, max(d) AS core FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS n FROM gap) WHERE n <= 10 GROUP BY 1)"""


def _space(spark, sf):
    return neighbours.vectors_of(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query("SELECT id, round_even(core, 6) AS core FROM core", _SPACE)
def t9_core_distances(spark, sf):
    near = neighbours.nearest(neighbours.blocks_of(_space(spark, sf)), 10)
    return density.core_distances(near, 10).withColumn("core", F.bround("core", 6))


@query(
    """WITH reach AS (SELECT a, b, greatest(d, p.core, q.core) AS w FROM gap JOIN core p ON p.id = a JOIN core q ON q.id = b),
grown AS (SELECT b AS id, w, a AS other, 1 AS step, first_value(b) OVER o AS next, first_value(w) OVER o AS least FROM reach WHERE a = (SELECT min(id) FROM v) WINDOW o AS (ORDER BY w, b)
  UNION ALL SELECT id, w, other, step, first_value(id) OVER o, first_value(w) OVER o FROM (SELECT g.id, least(g.w, r.w) AS w, CASE WHEN r.w < g.w THEN r.a ELSE g.other END AS other, step + 1 AS step FROM grown g JOIN reach r ON r.a = g.next AND r.b = g.id WHERE g.id <> g.next) WINDOW o AS (ORDER BY w, id))
SELECT round_even(w, 4) AS weight, count(*) AS n FROM (SELECT DISTINCT step, least AS w FROM grown) GROUP BY 1""",
    _SPACE,
)
def t9_spanning_tree(spark, sf):
    """The weights of the spanning tree of mutual reachability: those of any least tree."""
    blocks = neighbours.blocks_of(_space(spark, sf))
    near = written(neighbours.nearest(blocks, 20), "near")
    rounds = density.spanning_tree(blocks, near, written(density.core_distances(near, 10), "core"))
    return density.tree_edges(rounds).groupBy(F.bround("w", 4).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query()
def t9_density_clusters(spark, sf):
    """Each vector's cluster and strength: clusters of ten or more."""
    return density.fit(_space(spark, sf), 10, 3).points.select("id", "label", F.bround("strength", 6).alias("strength"))


@query(
    """WITH f AS (SELECT * FROM gap WHERE b % 5 <> 0), k AS (SELECT a AS id, max(d) AS core FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS n FROM f) WHERE n <= 10 GROUP BY 1),
r AS (SELECT f.a AS id, f.b AS neighbour, greatest(f.d, p.core, q.core) AS reach, row_number() OVER (PARTITION BY f.a ORDER BY greatest(f.d, p.core, q.core), f.b) AS n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS m FROM f WHERE a % 5 = 0) f JOIN k p ON p.id = f.a JOIN k q ON q.id = f.b WHERE m <= 20)
SELECT id, neighbour, round_even(reach, 6) AS reach FROM r WHERE n = 1""",
    _SPACE,
)
def t12_predict_neighbours(spark, sf):
    """Unseen vectors against a model of the others: where each would join the tree."""
    points = _space(spark, sf)
    model = density.fit(points.where("id % 5 <> 0"), 10, 10)
    return density.predict(model, points.where("id % 5 = 0")).select("id", "neighbour", F.bround("reach", 6).alias("reach"))


@query(
    """WITH n AS (SELECT a AS id, list(d ORDER BY d, b) AS d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS i FROM gap) WHERE i <= 10 GROUP BY 1),
r AS (SELECT id, d, d[1] AS rho, list_avg(d) AS mean, CAST(0 AS DOUBLE) AS low, 100 * list_avg(d) AS high, 0 AS step FROM n
  UNION ALL SELECT id, d, rho, mean, CASE WHEN s > log2(10) THEN low ELSE (low + high) / 2 END, CASE WHEN s > log2(10) THEN (low + high) / 2 ELSE high END, step + 1
  FROM (SELECT *, list_sum(list_transform(d, lambda x: exp(-greatest(0, x - rho) / ((low + high) / 2)))) AS s FROM r) WHERE step < 50)
SELECT id, round_even(rho, 6) AS rho, round_even(greatest((low + high) / 2, mean / 1000), 5) AS sigma FROM r WHERE step = 50""",
    _SPACE,
)
def t8_bandwidths(spark, sf):
    near = neighbours.nearest(neighbours.blocks_of(_space(spark, sf)), 10)
    return manifold.bandwidths(near).select("id", F.bround("rho", 6).alias("rho"), F.bround("sigma", 5).alias("sigma"))


@query()
def t8_projection(spark, sf):
    """Five coordinates of each vector that keep its neighbours."""
    placed = manifold.project(_space(spark, sf), 5, 8)
    return placed.select("id", *[F.bround(F.col("x")[i], 4).alias(f"x{i}") for i in range(5)])


@query()
def t10_topics(spark, sf):
    """Topics of all vectors: projection, then density clusters; -1 is noise."""
    found = density.fit(manifold.project(_space(spark, sf), 5, 8), 10, 5).points
    return found.select("id", F.col("label").alias("topic_id"), F.bround("strength", 4).alias("strength"))


@query()
def t7_encode(spark, sf):
    """The first coordinates of each document's vector, from the corpus itself."""
    _, vectors = encoder.fit(V.docs(spark, sf), F.col("abstract"), V.STOP, rank=16, size=2048)
    return vectors.select("id", *[F.bround(F.col("x")[i], 3).alias(f"x{i}") for i in range(3)])


@query()
def t13_signature_clusters(spark, sf):
    """Macro-topics from the topics' keyword signatures, encoded by a model of the documents."""
    model, matrix = encoder.learn(V.docs(spark, sf), F.col("abstract"), V.STOP, rank=16, size=2048)
    forget(matrix)
    signed = V.signatures(spark, sf).withColumn("key", F.xxhash64(F.concat_ws(":", "tier", F.col("topic_id").cast("string"))))
    signed = small(signed.select("key", "tier", "topic_id", "keywords_str"), "signed")  # a row a topic, read twice
    vectors = model.encode(signed, F.col("keywords_str"), "key")
    named = vectors.join(signed.select(F.col("key").alias("id"), "tier", "topic_id"), "id")
    return models.macro_clusters(named.select("tier", "topic_id", F.col("x").alias("vector")), 6)


# --- primitives ---------------------------------------------------------------------------------------------------


@query(
    """SELECT doc_id, coalesce(title, '') = '' AS no_title, length(title) AS n_title, len(string_split(categories, '|')) AS n_categories, CASE WHEN src > 0 THEN round_even(doc_id / src, 6) END AS safe_ratio,
  strftime(CAST(month || '-01' AS DATE) - INTERVAL 12 MONTH, '%Y-%m') AS year_before, datediff('day', DATE '2020-01-01', CAST(month || '-01' AS DATE)) // 30 AS spans, query_category || '-' || primary_category AS pair,
  CASE WHEN src > 12 THEN 'high' WHEN src < 4 THEN 'low' ELSE 'mid' END AS status, round_even(ln(1 + src), 6) AS log1p_src, greatest(3, least(9, src)) AS clamped, contains(lower(abstract), 'gan') AS has_gan FROM docs""",
    V.DOCS,
)
def f_scalars(spark, sf):
    d = V.docs(spark, sf)
    return d.select(
        "doc_id", (F.coalesce("title", F.lit("")) == "").alias("no_title"), F.length("title").cast("long").alias("n_title"), S.n_categories(F.col("categories")).cast("long").alias("n_categories"), F.bround(S.share(F.col("doc_id"), F.when(F.col("src") > 0, F.col("src"))), 6).alias("safe_ratio"),
        S.year_before(F.col("month")).alias("year_before"), S.months_between_floor(F.col("month"), F.lit("2020-01")).cast("long").alias("spans"), F.concat_ws("-", "query_category", "primary_category").alias("pair"),
        F.when(F.col("src") > 12, "high").when(F.col("src") < 4, "low").otherwise("mid").alias("status"), F.bround(F.log1p("src"), 6).alias("log1p_src"), F.greatest(F.lit(3), F.least(F.lit(9), F.col("src"))).alias("clamped"), S.contains_term(F.lower("abstract"), "gan").alias("has_gan"),
    )


@query(
    """SELECT category, month, count, CAST(sum(count) OVER w AS BIGINT) AS running, lag(count, 1) OVER o AS lag1, lag(count, 4) OVER o AS lag4, lead(count) OVER o AS nxt,
round_even(avg(count) OVER (PARTITION BY category, substr(month, 1, 4)), 6) AS year_mean, row_number() OVER (PARTITION BY category ORDER BY count DESC, month) AS rank
FROM months WINDOW o AS (PARTITION BY category ORDER BY month), w AS (PARTITION BY category ORDER BY month ROWS UNBOUNDED PRECEDING)""",
    V.MONTHS,
)
def w_windows(spark, sf):
    o = growth.by_month()
    return V.months(spark, sf).select(
        "category", "month", "count", F.sum("count").over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.lag("count", 1).over(o).alias("lag1"), F.lag("count", 4).over(o).alias("lag4"), F.lead("count").over(o).alias("nxt"),
        F.bround(F.avg("count").over(Window.partitionBy("category", F.substring("month", 1, 4))), 6).alias("year_mean"), F.row_number().over(Window.partitionBy("category").orderBy(F.col("count").desc(), "month")).cast("long").alias("rank"),
    )


@query(
    """SELECT query_category, count(*) AS n, count(DISTINCT month) AS n_months, min(tier) AS first_tier, round_even(avg(length(abstract)), 4) AS mean_len, round_even(stddev_samp(length(abstract)), 4) AS sd_len, round_even(stddev_pop(length(abstract)), 4) AS sdp_len,
CAST(sum(CASE WHEN topic_id = -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_noise, arg_min(month, (-length(abstract), doc_id)) AS longest_month, round_even(avg(pow(src - 8, 2)), 6) AS mse FROM docs GROUP BY 1""",
    V.DOCS,
)
def a_aggregates(spark, sf):
    n = F.length("abstract")
    return V.docs(spark, sf).groupBy("query_category").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("month").alias("n_months"), F.min("tier").alias("first_tier"), F.bround(F.avg(n), 4).alias("mean_len"), F.bround(F.stddev_samp(n), 4).alias("sd_len"), F.bround(F.stddev_pop(n), 4).alias("sdp_len"),
        F.sum((F.col("topic_id") == -1).cast("int")).alias("n_noise"), F.min_by("month", F.struct(-n, "doc_id")).alias("longest_month"), F.bround(F.avg(F.pow(F.col("src") - 8, F.lit(2))), 6).alias("mse"),
    )


@query("SELECT query_category, " + ", ".join(f"count(*) FILTER (WHERE tier = '{t}') AS {t}" for t in V.TIERS) + " FROM docs GROUP BY 1", V.DOCS)
def a10_crosstab(spark, sf):
    return V.docs(spark, sf).groupBy("query_category").pivot("tier", list(V.TIERS)).count().na.fill(0)


@query("SELECT a.topic_id, a.tier AS tier1, b.tier AS tier2, a.paper_count + b.paper_count AS papers FROM info a JOIN info b ON a.topic_id = b.topic_id AND a.tier < b.tier", V.DOCS, V.INFO)
def j_pairs(spark, sf):
    i = V.info(spark, sf)
    side = lambda k: i.select("topic_id", F.col("tier").alias(f"tier{k}"), F.col("paper_count").alias(f"n{k}"))
    return side(1).join(side(2), "topic_id").where("tier1 < tier2").select("topic_id", "tier1", "tier2", (F.col("n1") + F.col("n2")).alias("papers"))


@query("SELECT doc_id, 'in' AS side FROM docs SEMI JOIN (SELECT src FROM docs GROUP BY 1 HAVING count(*) > 40) USING (src) UNION ALL SELECT doc_id, 'out' AS side FROM docs ANTI JOIN (SELECT src FROM docs GROUP BY 1 HAVING count(*) > 40) USING (src)", V.DOCS)
def j_semi_anti(spark, sf):
    d = V.docs(spark, sf)
    large = d.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 40").select("src")
    parts = [d.join(large, "src", how).select("doc_id", F.lit(side).alias("side")) for how, side in (("left_semi", "in"), ("left_anti", "out"))]
    return reduce(DataFrame.unionByName, parts)


_TERM_HITS = " UNION ALL ".join(f"SELECT '{t}' AS term, count(*) AS n FROM docs WHERE contains(lower(abstract), '{t}')" for t in V.TERMS)


@query(_TERM_HITS, V.DOCS)
def j11_term_hits(spark, sf):
    low = F.lower("abstract")
    row = V.docs(spark, sf).agg(*[F.count_if(F.contains(low, F.lit(t))).alias(f"h{i}") for i, t in enumerate(V.TERMS)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"h{i}").alias("n")) for i, t in enumerate(V.TERMS)])))


@query("SELECT year, len(list_intersect(a, b)) AS n_both, len(list_distinct(list_concat(a, b))) AS n_any FROM (SELECT year, list(DISTINCT src) FILTER (WHERE lang_odd) AS a, list(DISTINCT src) FILTER (WHERE NOT lang_odd) AS b FROM (SELECT year, src, doc_id % 3 = 0 AS lang_odd FROM docs) GROUP BY 1)", V.DOCS)
def x_sets(spark, sf):
    third = F.col("doc_id") % 3 == 0
    s = V.docs(spark, sf).groupBy("year").agg(F.collect_set(F.when(third, F.col("src"))).alias("a"), F.collect_set(F.when(~third, F.col("src"))).alias("b"))
    return s.select("year", F.size(F.array_intersect("a", "b")).cast("long").alias("n_both"), F.size(F.array_union("a", "b")).cast("long").alias("n_any"))


@query("SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(abstract), ' ')) AS word FROM docs) WHERE word <> '' GROUP BY 1) ORDER BY n DESC, word LIMIT 30", V.DOCS)
def o3_most_common(spark, sf):
    words = V.docs(spark, sf).select(F.explode(F.split(F.lower("abstract"), " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(30)


@query("SELECT event_type AS category, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS count FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2")
def s_stream_daily_counts(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = streaming.read_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    root = streaming.shared_folder(spark)
    return streaming.run_once(streaming.windowed_counts(stream, "ts", "event_type"), root).withColumn("start", F.col("start").cast("timestamp_ntz"))


#: Days that end two days or more before the last event: those that the watermark has closed when all files are read.
_CLOSED = """closed AS (SELECT event_type AS category, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS count FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2
  HAVING date_trunc('day', any_value(ts)) + INTERVAL 3 DAY <= (SELECT max(ts) FROM events WHERE event_type IS NOT NULL))"""


def _closed_days(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = streaming.read_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.windowed_counts(stream, "ts", "event_type")


@query("SELECT category, start, count, round_even(avg(count) OVER o, 6) AS mean, count(*) OVER o AS n FROM closed WINDOW o AS (PARTITION BY category ORDER BY start ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)", _CLOSED)
def s_trailing_means(spark, sf):
    means = running.run_appended(running.trailing_means(_closed_days(spark, sf), 7), streaming.shared_folder(spark))
    return means.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("mean", F.bround("mean", 6))


@query(
    """WITH h AS (SELECT *, count(*) OVER o >= 6 AND count > avg(count) OVER o + 1.0 * stddev_pop(count) OVER o AS hot, lead(start) OVER (PARTITION BY category ORDER BY start) AS next FROM closed WINDOW o AS (PARTITION BY category ORDER BY start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY start) - row_number() OVER (PARTITION BY category, hot ORDER BY start) AS run FROM h),
b AS (SELECT category, min(start) AS start, arg_max(next, start) AS "end", max(start) AS last, arg_max(start, (count, -epoch(start))) AS peak, max(count) AS peak_count, count(*) AS rows FROM r WHERE hot GROUP BY category, run)
SELECT category, start, "end", peak, peak_count, rows FROM b WHERE last < (SELECT max(start) FROM closed c WHERE c.category = b.category)""",
    _CLOSED,
)
def s_bursts(spark, sf):
    found = running.run_appended(running.bursts(_closed_days(spark, sf), 12, 1.0), streaming.shared_folder(spark))
    return found.select("category", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end", "peak")], "peak_count", "rows")


@query(
    """WITH m AS (SELECT event_type AS category, ts, CASE WHEN ts - lag(ts) OVER o <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL WINDOW o AS (PARTITION BY event_type ORDER BY ts)),
n AS (SELECT category, ts, sum(new) OVER (PARTITION BY category ORDER BY ts) AS session FROM m)
SELECT category, CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS "end", count(*) AS count FROM n GROUP BY category, session"""
)
def s_sessions(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = streaming.read_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streaming.run_once(streaming.session_counts(stream, "ts", "event_type"), streaming.shared_folder(spark))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})

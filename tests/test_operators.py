"""The trend operators on hand-made frames: every rule that a real table may miss."""

import datetime as dt
import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.config import Tier
from tidemark.functions import kernels as K
from tidemark.functions import scalars as S
from tidemark.operators import advanced, experiments, final, growth, models, prep, topics, trends
from tidemark.sources import readers, sinks


def series(spark, values, category="a", start=(2000, 1)):
    rows = []
    for i, v in enumerate(values):
        y, m = divmod(start[0] * 12 + start[1] - 1 + i, 12)
        if v is not None:
            rows.append((category, f"{y:04d}-{m + 1:02d}", v))
    return spark.createDataFrame(rows, "category string, month string, count long")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_growth_by_calendar_and_by_row(spark):
    s = series(spark, [10, None, 30, *range(40, 130, 10), 20, 26, None, 60, 99])
    yoy = dict(rows(growth.year_over_year(s), "month", "yoy_pct"))
    assert yoy["2001-01"] == 100.0 and yoy["2001-02"] is None and yoy["2001-04"] == 50.0
    acc = rows(growth.acceleration(s), "month", "acceleration")
    assert [m for m, _ in acc] == ["2001-04", "2001-05"]


def test_multiples_and_zero_start(spark):
    s = series(spark, [4, 0, 8])
    got = rows(growth.multiples(s, [("p", "2000-01", "2000-03"), ("q", "1999-01", "2000-03"), ("r", "2000-02", "2000-03")]), "period", "start_count", "end_count", "multiplier")
    assert got == [("p", 4, 8, 2.0), ("q", 0, 8, 0.0), ("r", 0, 8, 0.0)]


def test_volatility_first_month_and_detrending(spark):
    s = series(spark, [100, 1, 2, 3, 4, 5, 6])
    era = [("e", "2000-01-01", "2000-12-31")]
    assert growth.volatility(s, era).first()["n_months"] == 7
    assert growth.volatility(s, era, lose_first_month=True).first()["n_months"] == 6
    line = series(spark, [10, 20, 30, 40, 50, 60])
    assert growth.volatility(line, era, detrended=True).first()["cv"] == pytest.approx(0, abs=1e-6)
    assert growth.volatility(series(spark, [1, 2]), era).count() == 0


def test_anomalies_need_six_months(spark):
    s = series(spark, [10, 10, 10, 10, 10, 10, 40, 10])
    got = growth.anomalies(s).collect()
    assert {r["month"] for r in got} == {"2000-06", "2000-07", "2000-08"}
    top = max(got, key=lambda r: r["deviation_pct"])
    assert top["month"] == "2000-07" and top["expected_ma12"] == 14
    assert min(r["deviation_pct"] for r in growth.anomalies(s, signed=True).collect()) < 0


def test_zero_base_gives_null_growth(spark):
    s = series(spark, [0, 1, 2, 3, 4]).unionByName(series(spark, [1, 1, 1, 2, 2], "b"))
    g = dict((r["month"], (r["x"], r["y"])) for r in growth.three_month_growth(s, ["a", "b"], ["x", "y"]).collect())
    assert g["2000-04"] == (None, 1.0) and g["2000-05"] == (3.0, 1.0)
    one = growth.growth_convergence(s, ["a", "b"], ["x", "y"]).collect()
    assert [r["month"] for r in one] == ["2000-05"] and one[0]["growth_mean"] == 2.0
    quirk = growth.growth_convergence(s, ["a", "b"], ["x", "y"], mean_with_std=True).first()
    assert quirk["growth_mean"] == pytest.approx((4 + math.sqrt(2)) / 3, abs=1e-6)


def test_calendar_spine_fills_gaps(spark):
    got = rows(growth.calendar_spine(series(spark, [3, None, None, 4])), "month", "count")
    assert got == [(dt.date(2000, 1, 31), 3), (dt.date(2000, 2, 29), 0), (dt.date(2000, 3, 31), 0), (dt.date(2000, 4, 30), 4)]


def test_month_pair_guards(spark):
    s = series(spark, [1, 4, 8, 2], start=(2001, 1)).unionByName(series(spark, [0, 0, 8, 2], start=(2002, 1)))
    got = growth.month_pair_effect(s, "a", [2001, 2002]).collect()
    assert [(r["year"], r["mar_jump_pct"], r["apr_drop_pct"]) for r in got] == [(2001, 100.0, -75.0)]


def test_dates_and_ranges(spark):
    df = spark.createDataFrame([(1, "2024-05-31T23:30:00Z"), (2, "nonsense"), (3, None), (4, "2024-06-01T00:00:00Z")], "doc_id long, published string")
    got = prep.with_dates(df)
    assert rows(got.where("month is not null"), "doc_id", "month") == [(1, "2024-05"), (4, "2024-06")]
    assert rows(prep.between_days(got, "2024-05-01", "2024-05-31"), "doc_id") == [(1,)]
    keys = spark.range(1).select(S.year_before(F.lit("2020-01")).alias("y"), S.month_range(F.lit("2019-11-05").cast("date"), F.lit("2020-02-01").cast("date")).alias("m"), S.quarter_key(F.lit("2020-06-30").cast("date")).alias("q")).first()
    assert keys["y"] == "2019-01" and keys["m"] == ["2019-11", "2019-12", "2020-01", "2020-02"] and keys["q"] == "2020Q2"


def test_cleaning_and_titles(spark):
    df = spark.createDataFrame([(1, "A  Big\tTitle", None, "2020-01"), (2, "a big title ", "x", "2020-02"), (3, None, "WithDrawn by author", None), (4, "t" * 120, "y", "2020-01"), (5, "T" * 120 + "z", "y", "2020-01")], "doc_id long, title string, abstract string, published_dt string")
    assert rows(prep.with_text(df), "doc_id", "text")[0] == (1, "A Big Title. ")
    assert rows(prep.without_withdrawn(df), "doc_id") == [(1,), (2,), (4,), (5,)]
    assert prep.without_withdrawn(df.select("doc_id")).count() == 5
    assert rows(prep.latest_title(df), "doc_id") == [(2,), (3,), (4,)]
    assert prep.keep_columns(df, ["title", "none"]).columns == ["title"]


def test_samples(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("g"), F.when(F.col("id") < 280, 0).otherwise(1).alias("cluster"))
    assert rows(prep.stratified_sample(df, ["g"], 10).groupBy("g").count(), "g", "count") == [(0, 10), (1, 10)]
    assert prep.stratified_sample(df, ["g"], 10).exceptAll(prep.stratified_sample(df.repartition(7), ["g"], 10)).count() == 0
    got = prep.diversity_sample(df, ["g"], "cluster", 20)
    assert got.groupBy("g").count().where("count > 20").count() == 0 and got.where("cluster = 1").count() >= 2
    assert prep.diversity_sample(df, ["g"], "cluster", 500).count() == 300


def test_tiers_in_one_plan(spark):
    tiers = [Tier("new", "n", "2021-01", "2021-12", "month", 1), Tier("old", "o", "2019-01", "2020-12", "year", 1)]
    df = spark.createDataFrame([(1, "t", "a", "2021-02", "c"), (2, "T", "a", "2021-03", "c"), (3, "t", "a", "2020-02", "c"), (4, "t", "a", "2018-02", "c"), (5, "u", "withdrawn", "2020-02", "c"), (6, "u", "a", "2020-02", "d")], "doc_id long, title string, abstract string, month string, primary_category string")
    assert rows(prep.prepare_tiers(df, tiers, ["c"]), "doc_id", "tier") == [(2, "new"), (3, "old")]


def test_top_terms_by_name_and_count(spark):
    df = spark.createDataFrame([(1, "zeta zeta zeta beta beta alpha the")], "g int, t string")
    assert rows(topics.top_terms(df, ["g"], F.col("t"), ["the"], vocabulary=2, keep=1), "term") == [("beta",)]
    assert rows(topics.top_terms(df, ["g"], F.col("t"), ["the"], vocabulary=2, keep=1, rank_by="count"), "term") == [("zeta",)]


def test_class_tfidf_formula(spark):
    df = spark.createDataFrame([(1, 0, "cat cat dog"), (2, 0, "cat bird"), (3, 1, "dog dog"), (4, 1, "bird dog")], "doc_id long, topic_id int, t string").withColumn("tier", F.lit("x"))
    got = {(r["topic_id"], r["keyword"]): r["weight"] for r in topics.class_tfidf(df, ["tier", "topic_id"], F.col("t"), ["the"], bigrams=False).collect()}
    average = (5 + 4) / 2
    assert got[(0, "cat")] == pytest.approx(3 / 5 * math.log(1 + average / 3), abs=1e-6)
    assert got[(1, "dog")] == pytest.approx(3 / 4 * math.log(1 + average / 4), abs=1e-6)


def test_coherence_against_plain_counts(spark):
    texts = ["x y q", "x y", "x z", "y z", "x y z", "w v"]
    df = spark.createDataFrame([(i, 0 if i < 5 else -1, t) for i, t in enumerate(texts)], "doc_id long, topic_id int, t string")
    got = topics.coherence(df, F.col("t"), stop_words=["q"]).first()
    sets = [set(t.split()) for t in texts]
    p = lambda *w: max(sum(set(w) <= s for s in sets) / 6, 1e-12)
    want = [max(-1, min(1, math.log(p(a, b) / (p(a) * p(b))) / -math.log(p(a, b)))) for a, b in (("x", "y"), ("x", "z"), ("y", "z"))]
    assert got["npmi"] == pytest.approx(sum(want) / 3, abs=1e-6) and got["n_pairs"] == 3
    assert topics.coherence(df.limit(0), F.col("t")).first()["npmi"] is None


def test_entropy_guards(spark):
    kw = spark.createDataFrame([("t", 0, 1, "only", 1.0)], "tier string, topic_id int, rank int, keyword string, weight double")
    info = spark.createDataFrame([("t", 0, 5), ("t", -1, 9)], "tier string, topic_id int, paper_count long")
    r = topics.diversity_entropy(kw, info).first()
    assert abs(r["shannon_entropy"]) == 0 and r["evenness"] == 0 and r["n_topics"] == 1
    counts = spark.createDataFrame([("t", 0, 5), ("t", 1, 5), ("t", -1, 10)], "tier string, topic_id int, n long")
    e = experiments.entropy(counts).first()
    assert e["entropy"] == 1.0 and e["effective_number"] == 2.0 and e["noise_rate"] == 0.5


def test_overlap_and_umbrella(spark):
    sets = spark.createDataFrame([(2000, "b", ["x", "deep nets", "gpt"]), (2000, "a", ["x", "gpt"]), (2000, "c", ["q"])], "year int, category string, terms array<string>")
    got = rows(final.umbrella_overlap(sets, ["b", "a", "c"], ["gpt", "deep net"]), "cat1", "cat2", "jaccard_raw", "jaccard_filtered")
    assert got == [("a", "c", 0.0, 0.0), ("b", "a", 0.6667, 1.0), ("b", "c", 0.0, 0.0)]


def test_bursts_open_and_short(spark):
    rates = [(t, f"{2000 + i // 12}-{i % 12 + 1:02d}", v) for t, hot in (("closed", range(10, 13)), ("open", range(21, 24)), ("short", [13])) for i, v in enumerate([9.0 if k in hot else 1.0 for k in range(24)])]
    df = spark.createDataFrame(rates, "term string, month string, rate double")
    got = advanced.bursts(df, 1.0).collect()
    assert [(r["term"], r["start"], r["end"], r["peak"], r["duration_months"]) for r in got] == [("closed", "2000-11", "2001-02", "2000-11", 3)]


def test_february_burst_is_too_short(spark):
    rates = [("t", f"{2001 + i // 12}-{i % 12 + 1:02d}", 9.0 if i in (12, 13) else 1.0) for i in range(24)]
    df = spark.createDataFrame(rates, "term string, month string, rate double")
    assert advanced.bursts(df, 1.0).count() == 0  # 59 days make one span of 30
    assert advanced.bursts(df, 1.0, min_spans=1).count() == 1


def test_paradigms(spark):
    df = spark.createDataFrame([(2000, "gan"), (2000, "x"), (2001, "organ"), (2001, "gan"), (2002, "x"), (None, "gan")], "year int, t string")
    loose = advanced.paradigm_halflife(df, F.col("t"), {"p": ["gan"], "none": ["zz"]}, 2002).collect()
    assert [(r["paradigm"], r["first_year"], r["peak_year"], r["peak_ratio"], r["status"]) for r in loose] == [("p", 2000, 2001, 1.0, "declining")]
    strict = advanced.paradigm_halflife(df, F.col("t"), {"p": ["gan"]}, 2002, whole_words=True).first()
    assert strict["peak_year"] == 2000 and strict["peak_ratio"] == 0.5


def test_lifecycle_rules(spark):
    labels = ["2023-2026", "2020-2023", "2016-2020", "1998-2016"]
    make = lambda m, new, old: [(m, 1, labels[0])] * new + [(m, 1, labels[3])] * old
    df = spark.createDataFrame(make(0, 5, 2) + make(1, 2, 4) + make(2, 3, 2) + make(3, 2, 1), "macro_id int, paper_count long, tier_label string")
    assert rows(advanced.lifecycle(df, labels), "macro_id", "lifecycle_stage") == [(0, "growing"), (1, "declining"), (2, "mature"), (3, "niche")]


def test_trend_series_zero_fill(spark):
    data = [("t", f"2000-{m:02d}", k) for m in range(1, 9) for k in ([0, 1] if m % 2 else [0])]
    df = spark.createDataFrame(data, "tier string, month string, topic_id int")
    s = trends.monthly_shares(df)
    assert s.count() == 16 and s.where("topic_id = 1 and y = 0").count() == 4
    t = {r["topic_id"]: r for r in trends.trend_table(s).collect()}
    tau = {r["topic_id"]: r["mk_tau"] for r in trends.kendall_tau(s).collect()}
    slope = {r["topic_id"]: r["ts_slope"] for r in trends.theil_sen_slope(s).collect()}
    for k in t:
        assert t[k]["mk_tau"] == pytest.approx(tau[k], abs=1e-6) and t[k]["ts_slope"] == pytest.approx(slope[k], abs=1e-8)
        assert t[k]["ts_slope_lo"] <= t[k]["ts_slope"] <= t[k]["ts_slope_hi"]


def test_change_points_of_a_step(spark):
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.normal(10, 1, 30), rng.normal(60, 1, 30)])
    assert K.pelt_rbf(y, 3 * math.log(60)) == [30]
    assert 29 in K.cusum_peaks(y)
    assert K.pelt_rbf(np.ones(5), 3.0) == [] and K.cusum_peaks(np.ones(5)) == []
    got = trends.change_points(series(spark, [int(v) for v in y])).collect()
    assert {r["method"] for r in got} <= {"PELT", "CUSUM", "PELT+CUSUM"} and any("PELT" in r["method"] for r in got)
    once = trends.cusum_once(series(spark, [int(v) for v in y])).first()
    assert once["position"] == 29 and once["accepted"]


def test_kernels():
    assert K.f_survival(4.0, 4, 13) == pytest.approx(0.0251, abs=5e-4)
    assert K.f_survival(1.0, 1, 1) == pytest.approx(0.5)
    assert K.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert K.kendall(np.arange(10.0))[0] == 1 and K.theil_sen(2 * np.arange(10.0))[0] == 2
    donors = np.array([[1.0, 2, 3, 5], [4, 1, 0, 2], [2, 2, 7, 1]])
    y = np.array([0.3, 0.7, 0.0]) @ donors
    assert K.simplex_weights(donors @ donors.T, donors @ y) == pytest.approx([0.3, 0.7, 0.0], abs=1e-8)
    v = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 1.0]])
    assert K.upgma_cosine(v, 2).tolist() == [0, 0, 1, 1]
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = np.concatenate([[0], x[:-1]]) + 0.01 * rng.normal(size=60)
    assert K.granger(x, y)[1] < 1e-6 < K.granger(y, rng.normal(size=60))[1]
    assert K.granger(x[:10], y[:10]) == (0.0, 1.0)


def test_synthetic_control_recovers_the_mix(spark):
    rng = np.random.default_rng(2)
    d = rng.integers(5, 50, (20, 2)).astype(float)
    df = spark.createDataFrame([(f"2000-{i:02d}", float(0.25 * a + 0.75 * b), a, b) for i, (a, b) in enumerate(d.tolist(), 1)], "month string, y double, a double, b double")
    out = final.synthetic_control(df, "y", ["a", "b"], ("2000-01", "2000-12"))
    assert out.where("abs(gap) > 1e-6").count() == 0


def plain_simplex(gram, target):
    """Every set of donors in closed form, the best feasible one."""
    best, value = None, math.inf
    for size in range(1, len(target) + 1):
        for s in map(list, itertools.combinations(range(len(target)), size)):
            system = np.ones((size + 1, size + 1))
            system[:size, :size], system[size, size] = gram[np.ix_(s, s)], 0
            w = np.zeros(len(target))
            w[s] = np.linalg.lstsq(system, np.append(target[s], 1.0), rcond=None)[0][:size]
            if (w >= -1e-10).all() and abs(w.sum() - 1) < 1e-8 and (v := w @ gram @ w - 2 * target @ w) < value - 1e-12:
                best, value = w, v
    return best


def test_simplex_weights_equal_the_best_of_all_sets():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        for _ in range(8):
            x, y = rng.normal(0, 1, (n, 30)), rng.normal(0, 1, 30)
            assert K.simplex_weights(x @ x.T, x @ y) == pytest.approx(plain_simplex(x @ x.T, x @ y), abs=1e-7)


def test_simplex_weights_of_many_donors_meet_the_conditions():
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(50, 20, (40, 60)))
    x[7] = x[3]  # equal donors
    y = 0.6 * x[3] + 0.4 * x[20] + rng.normal(0, 2, 60)
    start = time.perf_counter()
    w = K.simplex_weights(x @ x.T, x @ y)
    assert time.perf_counter() - start < 1
    slope = 2 * (x @ x.T @ w - x @ y)
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    assert slope.min() >= slope[w > 1e-9].max() - 1e-6 * np.abs(slope).max()  # all used donors share the least slope


def test_logistic_curves_are_recovered(spark):
    rng = np.random.default_rng(3)
    truth = {"a": (1000, 40, 0.15), "b": (500, 20, 0.3), "c": (20000, 70, 0.08)}
    rows = []
    for key, (capacity, middle, rate) in truth.items():
        y = capacity / (1 + np.exp(-rate * (np.arange(90) - middle)))
        rows += [(key, f"{2010 + m // 12}-{m % 12 + 1:02d}", float(v)) for m, v in enumerate(np.diff(y, prepend=0) + rng.normal(0, 1e-3, 90))]
    rows += [("short", "2010-01", 3.0), ("short", "2010-02", 4.0), ("flat", "2010-01", 5.0)] + [("flat", f"2010-{m:02d}", 0.0) for m in range(2, 12)] + [(None, "2010-01", 1.0)]
    got = {r["category"]: r for r in advanced.growth_curves(spark.createDataFrame(rows, "category string, month string, count double")).collect()}
    for key, (capacity, middle, rate) in truth.items():
        assert (got[key]["capacity"], got[key]["midpoint"], got[key]["rate"]) == pytest.approx((capacity, middle, rate), rel=0.02) and got[key]["fit"] > 0.999
    assert {k: r["stage"] for k, r in got.items()} == {"a": "mature", "b": "mature", "c": "mature" if 1 / (1 + math.exp(-0.08 * 19)) >= 0.8 else "growing", "short": "unclear", "flat": "unclear"}


def test_apc_splits_age_and_period(spark):
    data = [(f"T{t}", k, 10 * (5 - t)) for t in (1, 2, 3) for k in range(t, 6)]
    df = spark.createDataFrame(data, "tier string, topic_id int, paper_count long")
    apc = final.age_period_cohort(df, ["T1", "T2", "T3"])
    c = {r["variable"]: r["coefficient"] for r in final.apc_coefficients(apc).collect()}
    assert c["age"] == pytest.approx(c["period"]) and 0 <= c["r_squared"] <= 1


def test_granger_table(spark):
    s = series(spark, list(range(10, 130))).unionByName(series(spark, [x % 7 + 3 for x in range(120)], "b"))
    got = final.granger_tests(final.quarterly_growth(s)).collect()
    assert {(r["cause"], r["effect"]) for r in got} == {("a", "b"), ("b", "a")} and all(r["p_adjusted"] >= r["p_value"] for r in got)


def test_runner_isolates_failures():
    done = []
    status = final.run_all({"bad": lambda: 1 / 0, "good": lambda: 3}, lambda n, d: done.append((n, d)))
    assert done == [("good", 3)] and status["good"] == "ok" and status["bad"].startswith("failed: ZeroDivisionError")


def test_models(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(0, 0.05, 6) + np.eye(6)[i % 3]]) for i in range(90)]
    df = spark.createDataFrame(data, "doc_id long, embedding array<float>")
    model = models.fit_topics(df, 3, 3)
    sinks.save_model(model, str(tmp_path / "m"))
    got = models.assign_topics(models.load_topics(str(tmp_path / "m")), df, 1.5)
    assert got.groupBy((F.col("doc_id") % 3).alias("g")).agg(F.countDistinct(F.when(F.col("topic_id") != -1, F.col("topic_id"))).alias("k")).where("k <> 1").count() == 0
    assert 0 < got.where("topic_id = -1").count() <= 15
    means = models.mean_vectors(df.withColumn("tier", F.lit("t")).withColumn("topic_id", (F.col("doc_id") % 9).cast("int")), ["tier", "topic_id"])
    macro = models.macro_clusters(means, 3)
    assert macro.groupBy((F.col("topic_id") % 3).alias("g")).agg(F.countDistinct("macro_id").alias("k")).where("k <> 1").count() == 0
    assert models.macro_clusters(means, 3, "bisecting").count() == 9
    vec = models.encode(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda s: np.array([[len(x), 1.0] for x in s]))
    assert sorted(r["embedding"] for r in vec.collect()) == [[0.0, 1.0], [2.0, 1.0]]


def test_missing_model_is_fitted_again_and_saved(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i % 3 == k) for k in range(3)]) for i in range(30)], "doc_id long, embedding array<float>")
    path, calls = str(tmp_path / "m"), []
    refit = lambda: calls.append(1) or models.fit_topics(df, 3, 2)
    with pytest.raises(Exception):
        models.load_topics(path)
    models.load_topics(path, refit)
    models.load_topics(path, refit)
    assert len(calls) == 1


def test_stop_words_from_a_file(spark, tmp_path):
    from tidemark.functions import words

    (tmp_path / "w.txt").write_text("The a  an\n# none\nof the # again\n")
    assert words.from_file(spark, str(tmp_path / "w.txt")) == ["the", "a", "an", "of"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a, \"b\"\nc", "2020-01", "PELT")], readers.CHANGE_POINTS)
    sinks.write_csv(df, str(tmp_path / "out"))
    back = readers.read_csv(spark, str(tmp_path / "out"), readers.CHANGE_POINTS)
    assert back.collect() == df.collect()
    (tmp_path / "bad.csv").write_text("topic_id,rank,keyword,weight\n1,1,x,0.5\nno,1,y,0.5\n", encoding="utf-8-sig")
    assert readers.read_csv(spark, str(tmp_path / "bad.csv"), readers.KEYWORDS).count() >= 1
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "bad.csv"), readers.KEYWORDS, strict=True).collect()
    assert readers.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "bad.csv")]).endswith("bad.csv")
    assert [p.rsplit("/", 1)[1] for p in readers.find_files(spark, str(tmp_path / "*.csv"))] == ["bad.csv"]
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [str(tmp_path / "none")])
    sinks.write_table(df, str(tmp_path / "t"), ["category"])
    sinks.write_report(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    assert sinks.melt(spark.createDataFrame([(1, 2.0, 3.0)], "k int, a double, b double"), "k").count() == 2
    assert '"method":"PELT"' in sinks.as_json(df).first()["report"]


def test_settings_from_yaml(tmp_path):
    (tmp_path / "c.yaml").write_text("categories: [x, y]\nburst: {sigma_threshold: 1.5, target_terms: [a]}\ntiers: {T: {label: l, start: '2020-06-01', end: '2021-05-31', group_by: year, sample_per_group: 7}}\nparadigms: {P: {terms: [q]}}\nsynthetic_control: {pre_period: ['2020-06-01', '2022-10-31']}\n")
    s = config.load(str(tmp_path / "c.yaml"))
    assert s.categories == ("x", "y") and s.burst_sigma == 1.5 and s.burst_terms == ("a",) and s.tiers == (Tier("T", "l", "2020-06", "2021-05", "year", 7),)
    assert s.paradigms == {"P": ("q",)} and s.control_pre == ("2020-06", "2022-10") and config.load().granger_lags == 4


def test_paths_and_stamps():
    from datetime import datetime

    assert sinks.under("/a/", "b/c") == "/a/b/c" and sinks.under("/a", "/b") == "/b" and sinks.under("/a", "s3://x/y") == "s3://x/y"
    assert sinks.stamp(datetime(2024, 1, 2, 3, 4, 5)) == "2024-01-02 03:04:05"


def test_study_follows_the_settings(spark):
    from tidemark.plans import study

    rows = [(i, f"title {i % 7} alpha", f"beta gamma {'delta' if i % 4 else 'omega'} word{i % 11}", f"20{18 + i % 4}-{1 + i % 12:02d}-11T00:00:00Z", "xy"[i // 5 % 2], "xy"[i // 5 % 2], "x|y" if i % 3 else "x") for i in range(480)]
    papers = spark.createDataFrame(rows, "doc_id long, title string, abstract string, published string, primary_category string, query_category string, categories string")
    s = config.from_tree({"categories": ["x", "y"], "start_date": "2018-01-01", "end_date": "2021-12-31", "jaccard": {"k_values": [2, 4], "top_n_keywords": 3, "umbrella_terms": ["gamma"]}, "paradigms": {"P": {"terms": ["omega"]}}, "burst": {"target_terms": ["omega"], "sigma_threshold": 0.5, "min_duration_months": 2}, "pelt": {"sensitivity_penalties": [0.01, 50.0]}, "synthetic_control": {"pre_period": ["2018-01", "2019-12"], "post_period": ["2020-01", "2021-12"]}, "cvpr": {"treatment_category": "x", "years": [2018, 2019]}, "eras": {"cv_eras": [["all", "2018-01-01", "2021-12-31"]]}, "sample_per_group": 3})
    jobs = study.analyses(papers, s, ["the"], min_year=10, min_category=5)
    results = {}
    status = final.run_all(jobs, lambda name, df: results.__setitem__(name, df.collect()))
    assert set(status.values()) == {"ok"}, status
    assert {r["k"] for r in results["overlap_sensitivity"]} == {2, 4} and {r["era"] for r in results["volatility"]} == {"all"}
    assert {r["paradigm"] for r in results["paradigm_halflife"]} == {"P"} and {r["year"] for r in results["month_pair"]} <= {2018, 2019}
    assert len(results["control_summary"]) == 1 and len(results["sample"]) <= 3 * 2 * 48

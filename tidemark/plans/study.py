"""All analyses of one table of papers by name, as the settings ask: what a run hands to ``final.run_all``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import scalars as S
from tidemark.operators import advanced, final, growth, prep, trends
from tidemark.tables import small


def analyses(papers: DataFrame, settings: Settings, stop_words: Sequence[str], id_column: str = "doc_id", min_year: int = 100, min_category: int = 50) -> dict[str, Callable[[], DataFrame]]:
    """Name -> lazy result. ``papers``: id, title, abstract, published, primary_category, query_category, categories.

    The treated series of the synthetic control is the second category; the others are its donors.
    """
    s, text = settings, S.analysis_text(F.col("title"), F.col("abstract"))
    dated = prep.between_days(prep.with_dates(papers.drop("month", "year")), s.start_date, s.end_date).withColumn("year", F.year("published_dt"))
    counts = growth.monthly_counts(dated, "query_category")
    spine = growth.calendar_spine(counts).withColumn("month", F.date_format("month", "yyyy-MM"))
    names = [f"n{i}" for i in range(len(s.categories))]
    limits = {"min_year": min_year, "min_category": min_category}

    longest = max(100, s.top_n_keywords, *s.k_values)

    @cache
    def ranked() -> DataFrame:
        """Written once: the sets of all lengths are cut from it, so that the texts are taken apart once."""
        return small(advanced.ranked_sets(dated, text, s.categories, stop_words, longest, **limits), "ranked-terms")

    def sets(keep: int) -> DataFrame:
        return advanced.sets_of(ranked(), max(100, keep), keep)

    def changes(penalty: float) -> DataFrame:
        return trends.change_points(spine, penalty, s.pelt_jump, s.pelt_min_size)

    def control() -> DataFrame:
        wide = growth.wide(counts, s.categories).select("month", *[F.col(f"`{c}`").alias(n) for c, n in zip(s.categories, names)])
        return final.synthetic_control(wide, names[1], [n for n in names if n != names[1]], s.control_pre)

    def each(values: Sequence, column: str, make: Callable[..., DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [make(v).withColumn(column, F.lit(v)) for v in values])

    return {
        "monthly_counts": lambda: counts,
        "year_over_year": lambda: growth.year_over_year(counts),
        "acceleration": lambda: growth.acceleration(counts),
        "volatility": lambda: growth.volatility(counts, s.eras),
        "seasonal": lambda: growth.seasonal(counts),
        "anomalies": lambda: growth.anomalies(counts),
        "month_pair": lambda: growth.month_pair_effect(counts, s.pair_category, s.pair_years, s.pair_months),
        "shares": lambda: growth.shares(counts, s.categories, names),
        "growth_correlation": lambda: growth.growth_correlation(counts, s.categories, names),
        "growth_convergence": lambda: growth.growth_convergence(counts, s.categories, names),
        "change_points": lambda: changes(s.pelt_penalty),
        "penalty_sensitivity": lambda: each([float(p) for p in s.sensitivity_penalties], "penalty", changes).groupBy("penalty", "category").agg(F.count(F.lit(1)).alias("n_changes")),
        "paradigm_halflife": lambda: advanced.paradigm_halflife(dated, text, s.paradigms, int(s.end_date[:4]), s.first_appearance),
        "convergence": lambda: advanced.pair_overlap(sets(s.top_n_keywords), s.categories),
        "convergence_trend": lambda: advanced.convergence_trend(advanced.pair_overlap(sets(s.top_n_keywords), s.categories), s.early[1], s.late[0]),
        "overlap_sensitivity": lambda: each(s.k_values, "k", lambda k: advanced.pair_overlap(sets(k), s.categories)),
        "umbrella_overlap": lambda: final.umbrella_overlap(sets(s.top_n_keywords), s.categories, s.umbrella_terms),
        "bursts": lambda: advanced.bursts(advanced.term_rates(dated, text, s.burst_terms), s.burst_sigma, s.burst_min_months - 1),
        "lead_lag": lambda: final.granger_tests(final.quarterly_growth(counts), s.granger_lags, s.fdr_alpha),
        "synthetic_control": control,
        "control_summary": lambda: final.control_summary(control(), s.control_pre, s.control_post),
        "multi_category": lambda: final.multi_category_trend(dated),
        "sample": lambda: prep.stratified_sample(dated, ["month", "primary_category"], s.sample_per_group, id_column, s.random_seed),
        "tiers": lambda: prep.prepare_tiers(dated.drop("tier"), s.tiers, s.categories),
    }

"""Scalar functions as column expressions: dates, text cleaning, terms, safe arithmetic."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]{2,}"


def timestamp_of(col: Column) -> Column:
    """ISO text as a UTC timestamp; null where it is none."""
    return F.try_to_timestamp(col)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_start(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")))


def year_before(month: Column) -> Column:
    return F.date_format(F.add_months(month_start(month), -12), "yyyy-MM")


def quarter_key(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def month_range(start: Column, end: Column) -> Column:
    """All months from ``start`` to ``end``, both included, as yyyy-MM."""
    days = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    return F.transform(days, lambda d: F.date_format(d, "yyyy-MM"))


def months_between_floor(end: Column, start: Column) -> Column:
    """Whole spans of 30 days."""
    return F.floor(F.datediff(month_start(end), month_start(start)) / 30).cast("int")


def clean_text(col: Column) -> Column:
    """Null as empty, any blank run as one space, ends stripped."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", " "))


def title_key(col: Column) -> Column:
    return F.substring(clean_text(F.lower(col)), 1, 100)


def analysis_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def without(words: Column, stop_words: Iterable[str]) -> Column:
    stop = list(stop_words)
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def contains_term(text: Column, term: str, whole_words: bool = False) -> Column:
    """Substring test as the analyses have it; ``whole_words`` avoids hits inside longer words."""
    if not whole_words:
        return F.contains(text, F.lit(term))
    return F.rlike(text, F.lit(r"(?U)(?<!\w)\Q" + term + r"\E(?!\w)"))


def contains_any(text: Column, terms: Iterable[str], whole_words: bool = False) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | contains_term(text, t, whole_words)
    return out


def n_categories(col: Column) -> Column:
    return F.size(F.split(F.coalesce(col, F.lit("")), r"\|"))


def share(part: Column, whole: Column) -> Column:
    """part / whole; null where whole is 0 or null."""
    return F.when(whole != 0, part / whole)


def share_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(share(part, whole), F.lit(0.0))


def label_of(words: Column) -> Column:
    """Three words, title case, joined by plus signs."""
    return F.array_join(F.transform(F.slice(words, 1, 3), F.initcap), " + ")

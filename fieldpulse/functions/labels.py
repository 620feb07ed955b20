"""Scores, buckets and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldpulse import settings


def rate_ratio(
    recent: Column,
    baseline: Column,
    recent_days: int = settings.RECENT_DAYS,
    baseline_days: int = settings.BASELINE_DAYS,
) -> Column:
    """Recent rate over own baseline rate; NULL without a baseline."""
    return F.when(baseline > 0, (recent / recent_days) / (baseline / baseline_days))


def severity(ratio: Column) -> Column:
    chain = F.when(ratio.isNull(), None)
    for threshold, label in settings.SEVERITY:
        chain = chain.when(ratio >= threshold, label)
    return chain.otherwise("none")


def ratio_label(ratio: Column) -> Column:
    """Two decimals; an exact tie goes to the even digit, as ``format_number`` rounds."""
    digits = F.call_function("format_number", ratio, F.lit("0.00"))
    return F.when(ratio.isNull(), settings.NO_BASELINE).otherwise(F.concat(digits, F.lit("×")))


def severity_label(level: Column) -> Column:
    return F.when(F.coalesce(F.length(level), F.lit(0)) == 0, settings.NO_BASELINE).otherwise(level)


def severity_badge(level: Column) -> Column:
    """Unscored patterns are new, not harmless, so they read as emerging."""
    return F.coalesce(level, F.lit("emerging"))


def novelty_label(verdict: Column) -> Column:
    chain = F.when(verdict.isNull(), "unassessed")
    for code, label in settings.NOVELTY_LABELS.items():
        chain = chain.when(verdict == code, label)
    return chain.otherwise("unassessed")


def title_case(col: Column) -> Column:
    """Capital after every non-letter, not only after whitespace."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2))),
        ),
        "",
    )


def category_label(raw: Column, labels: dict[str, str] | None = None) -> Column:
    """Plain label of a category code; unmapped codes are title-cased and starred."""
    table = settings.CATEGORY_LABELS if labels is None else labels
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return (
        F.when(F.coalesce(F.length(raw), F.lit(0)) == 0, "Uncategorised")
        .when(F.try_element_at(mapping, raw).isNotNull(), F.try_element_at(mapping, raw))
        .otherwise(F.concat(title_case(raw), F.lit(" *")))
    )


def vehicle(make: Column, model: Column) -> Column:
    return F.concat(make, F.lit(" "), model)

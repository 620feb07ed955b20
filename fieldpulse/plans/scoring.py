"""Recent rate of every pattern against its own trailing baseline, and rate profiles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse import settings
from fieldpulse.functions.dates import score_windows
from fieldpulse.functions.labels import rate_ratio, severity


def window_counts(
    members: DataFrame,
    reports: DataFrame,
    today: dt.date,
    recent_days: int = settings.RECENT_DAYS,
    baseline_days: int = settings.BASELINE_DAYS,
) -> DataFrame:
    """``(pattern_id, recent_count, baseline_count)`` for patterns with a report in either window.

    The recent window includes both its ends; missing and future dates fall outside. The date
    bounds are a plain filter on the report scan, so files outside them are skipped.
    """
    start, recent = (F.lit(d) for d in score_windows(today, recent_days, baseline_days))
    day = F.col("date_of_incident")
    dated = reports.select("odi_number", "date_of_incident").filter(
        (day >= start) & (day <= F.lit(today))
    )
    return (
        members.select("pattern_id", "odi_number")
        .join(dated, "odi_number")
        .groupBy("pattern_id")
        .agg(
            F.count_if(day >= recent).alias("recent_count"),
            F.count_if(day < recent).alias("baseline_count"),
        )
    )


def score_patterns(
    patterns: DataFrame,
    members: DataFrame,
    reports: DataFrame,
    today: dt.date,
    recent_days: int = settings.RECENT_DAYS,
    baseline_days: int = settings.BASELINE_DAYS,
) -> DataFrame:
    """``(id, recent_count, baseline_count, ratio, severity)`` for every pattern."""
    counts = window_counts(members, reports, today, recent_days, baseline_days)
    zero = F.lit(0).cast("bigint")
    return (
        patterns.select("id")
        .join(counts.withColumnRenamed("pattern_id", "id"), "id", "left")
        .select(
            "id",
            F.coalesce("recent_count", zero).alias("recent_count"),
            F.coalesce("baseline_count", zero).alias("baseline_count"),
        )
        .withColumn(
            "ratio",
            rate_ratio(F.col("recent_count"), F.col("baseline_count"), recent_days, baseline_days),
        )
        .withColumn("severity", severity(F.col("ratio")))
    )


def scoring_report(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("patterns_scored"),
        F.count_if(F.col("baseline_count") > 0).alias("patterns_with_ratio"),
        F.count_if(F.col("baseline_count") == 0).alias("patterns_baseline_zero"),
    )


def rate_curve(members: DataFrame, reports: DataFrame, unit: str = "month") -> DataFrame:
    """Reports per pattern and calendar period of the incident."""
    return (
        members.select("pattern_id", "odi_number")
        .join(reports.select("odi_number", "date_of_incident"), "odi_number")
        .filter(F.col("date_of_incident").isNotNull())
        .groupBy("pattern_id", F.date_trunc(unit, "date_of_incident").cast("date").alias("period"))
        .agg(F.count("*").alias("reports"))
    )


def cohorts(members: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports and incident span per pattern and model year."""
    return (
        members.select("pattern_id", "odi_number")
        .join(reports.select("odi_number", "model_year", "date_of_incident"), "odi_number")
        .groupBy("pattern_id", "model_year")
        .agg(
            F.count("*").alias("reports"),
            F.min("date_of_incident").alias("first_incident"),
            F.max("date_of_incident").alias("last_incident"),
        )
    )


def filing_lag(reports: DataFrame, *by: str) -> DataFrame:
    """Days between incident and filing."""
    lag = F.datediff("date_complaint_filed", "date_of_incident")
    return (
        reports.select(*by, lag.alias("_lag"))
        .filter(F.col("_lag").isNotNull())
        .groupBy(*by)
        .agg(
            F.count("*").alias("reports"),
            F.avg("_lag").alias("mean_days"),
            F.min("_lag").alias("min_days"),
            F.max("_lag").alias("max_days"),
        )
    )

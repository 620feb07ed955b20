"""Date parsing with the format pinned per feed; nothing is inferred."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldpulse.functions.text import is_blank, strip_ws


def feed_date(col: Column, fmt: str) -> Column:
    """``struct<value: date, ok: boolean>``: blank is a valid missing date, bad text is not."""
    shaped = F.when(strip_ws(col).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), strip_ws(col))
    value = F.try_to_date(shaped, fmt)
    return F.struct(value.alias("value"), (is_blank(col) | value.isNotNull()).alias("ok"))


def flat_date(col: Column, fmt: str) -> Column:
    return F.try_to_date(col, fmt)


def score_windows(
    today: dt.date, recent_days: int, baseline_days: int
) -> tuple[dt.date, dt.date]:
    """(baseline start, recent start) counted back from ``today``."""
    recent = today - dt.timedelta(days=recent_days)
    return recent - dt.timedelta(days=baseline_days), recent

"""Filing delay: a reporting triangle, completion factors, and counts corrected for filings still to come.

Reports are filed some time after the incident, so the newest incident windows always look low. Incident
windows by delay in windows form a triangle of what is known as of a date; how the older windows have grown
from one delay to the next tells how far the newer ones still have to go.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(day: Column, start: dt.date, days: int) -> Column:
    return F.floor(F.datediff(day, F.lit(start)) / days).cast("int")


def triangle(reports: DataFrame, incident: str, filed: str, by: list[str], start: dt.date, as_of: dt.date, days: int) -> DataFrame:
    """``(*by, origin, delay, n, known)``: reports per incident window and delay, and all up to that delay.

    Windows of ``days`` count from ``start``. Only whole windows up to ``as_of`` are looked at: the cells whose
    ``origin + delay`` is before the window of the day after. A cell without reports is there with zero, so
    each group has the same triangle. Reports without a date, from before ``start``, or filed before
    their incident take no part.
    """
    windows = ((as_of - start).days + 1) // days
    if windows < 1:
        raise ValueError("as_of must leave at least one whole window")
    counted = (
        reports.select(*by, _window(F.col(incident), start, days).alias("origin"), _window(F.col(filed), start, days).alias("_filed"))
        .filter("origin >= 0 and _filed >= origin").filter(F.col("_filed") < windows)
        .groupBy(*by, "origin", (F.col("_filed") - F.col("origin")).alias("delay")).agg(F.count("*").alias("n"))
    )
    cells = F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("origin")
    empty = reports.select(*by).distinct().select(*by, cells).select(
        *by, "origin", F.explode(F.sequence(F.lit(0), F.lit(windows - 1) - F.col("origin"))).alias("delay"), F.lit(0).cast("bigint").alias("n")
    )
    filled = counted.unionByName(empty).groupBy(*by, "origin", "delay").agg(F.sum("n").alias("n"))
    # At most one row per window and delay in a group of the window.
    upto = Window.partitionBy(*by, "origin").orderBy("delay")
    return filled.withColumn("known", F.sum("n").over(upto))


def completion(cells: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, delay, growth, complete)`` of a :func:`triangle`.

    ``growth`` is how the reports known at a delay grow to the next, over all incident windows that have both;
    ``complete`` is the share of all reports that is known at the delay, the inverse of the growth from there
    on. A delay without reports to grow from has growth one, as has the last.
    """
    later = cells.select(*by, "origin", (F.col("delay") - 1).alias("delay"), F.col("known").alias("_then"))
    both = cells.join(later, [*by, "origin", "delay"], "left")
    sums = both.groupBy(*by, "delay").agg(
        F.sum("_then").alias("_then"), F.sum(F.when(F.col("_then").isNotNull(), F.col("known"))).alias("_now")
    )
    growth = F.when(F.col("_now") > 0, F.col("_then") / F.col("_now")).otherwise(F.lit(1.0))
    ahead = Window.partitionBy(*by).orderBy("delay").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return sums.select(*by, "delay", growth.alias("growth")).withColumn("complete", 1 / F.product("growth").over(ahead))


def corrected_counts(cells: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, origin, delay, known, complete, expected)``: the newest cell of each incident window and what it should grow to."""
    newest = cells.groupBy(*by, "origin").agg(F.max("delay").alias("delay"), F.max_by("known", "delay").alias("known"))
    shares = completion(cells, by).select(*by, "delay", "complete")
    return newest.join(shares, [*by, "delay"]).select(
        *by, "origin", "delay", "known", "complete", (F.col("known") / F.col("complete")).alias("expected")
    )

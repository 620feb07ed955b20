"""Delimited complaint feed: scan, vehicle scope, collapse to one row per complaint."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpulse import settings
from fieldpulse.functions.dates import flat_date
from fieldpulse.functions.text import coarse_components

FLAT_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in settings.FLAT_FIELDS])


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the feed as text. Quotes are data; only tabs delimit."""
    return (
        spark.read.schema(FLAT_SCHEMA)
        .option("sep", "\t")
        .option("header", "false")
        .option("encoding", "utf-8")
        .option("quote", "")
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def in_family(make: Column, model: Column, models: Iterable[tuple[str, str]]) -> Column:
    """Configured model or a variant of it after one space: ``Z-9 HYBRID``, not ``Z-90``."""
    upper_make, upper_model = F.upper(make), F.upper(model)
    tests = [
        (upper_make == mk.upper())
        & ((upper_model == md.upper()) | upper_model.startswith(md.upper() + " "))
        for mk, md in models
    ]
    return reduce(lambda a, b: a | b, tests)


def is_vehicle() -> Column:
    return F.col("PROD_TYPE") == "V"


def in_scope(models: Iterable[tuple[str, str]], years: Iterable[int]) -> Column:
    year = F.expr("try_cast(YEARTXT AS int)")
    return is_vehicle() & in_family(F.col("MAKETXT"), F.col("MODELTXT"), models) & year.isin(list(years))


def collapse(
    raw: DataFrame,
    models: Iterable[tuple[str, str]] = settings.MODELS,
    years: Iterable[int] = settings.MODEL_YEARS,
) -> DataFrame:
    """One row per complaint number with its components gathered and its dates parsed.

    The other columns are constant within a complaint; ``min`` picks the same value on
    every run and combines before the shuffle. The VIN is never selected.
    """
    constant = {
        "make": "MAKETXT", "model": "MODELTXT", "model_year": "YEARTXT", "summary": "CDESCR",
        "faildate": "FAILDATE", "ldate": "LDATE", "crash": "CRASH", "fire": "FIRE",
        "injured": "INJURED", "deaths": "DEATHS",
    }
    one = (
        raw.filter(in_scope(models, years))
        .groupBy("ODINO")
        .agg(
            F.array_sort(F.collect_set(F.trim("COMPDESC"))).alias("components"),
            *[F.min(src).alias(dst) for dst, src in constant.items()],
        )
        .filter(F.col("summary").isNotNull())
    )
    return one.select(
        F.expr("try_cast(ODINO AS bigint)").alias("odi_number"),
        "make",
        "model",
        F.expr("try_cast(model_year AS int)").alias("model_year"),
        "components",
        coarse_components(F.col("components")).alias("components_coarse"),
        "summary",
        flat_date(F.col("faildate"), settings.FLAT_DATE).alias("date_of_incident"),
        flat_date(F.col("ldate"), settings.FLAT_DATE).alias("date_complaint_filed"),
        (F.col("crash") == "Y").alias("crash"),
        (F.col("fire") == "Y").alias("fire"),
        F.expr("try_cast(injured AS int)").alias("injuries"),
        F.expr("try_cast(deaths AS int)").alias("deaths"),
    )


def funnel(
    raw: DataFrame,
    models: Iterable[tuple[str, str]] = settings.MODELS,
    years: Iterable[int] = settings.MODEL_YEARS,
    *,
    written: DataFrame,
) -> DataFrame:
    """One row of counts: loaded, vehicles, scoped and deduped from a scan of the feed, and the rows in ``written``.

    ``written`` is the table as it was read back after the write, so that a loss on the way shows.
    """
    scope = F.coalesce(in_scope(models, years), F.lit(False))
    stored = F.when(scope & F.col("CDESCR").isNotNull(), F.col("ODINO"))
    counts = raw.agg(
        F.count("*").alias("rows_loaded"),
        F.count_if(is_vehicle()).alias("rows_vehicles"),
        F.count_if(scope).alias("rows_scoped"),
        F.count_distinct(stored).alias("complaints_deduped"),
    ).withColumn("written", F.lit(0))
    stored_rows = written.agg(F.count("*").alias("written"))
    names = counts.columns
    both = counts.unionByName(stored_rows.select(*[F.lit(0).alias(c) for c in names[:-1]], "written"))
    return both.agg(*[F.sum(c).alias(c) for c in names])

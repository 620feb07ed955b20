"""Landed API responses: triage by status, envelopes, listings, paged feeds, work list."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.functions.text import clip, names_variant
from fieldpulse.runtime import first_true

REPORT_RECORD = (
    "struct<odiNumber:bigint,summary:string,dateOfIncident:string,dateComplaintFiled:string,"
    "components:string,crash:boolean,fire:boolean,numberOfInjuries:int,numberOfDeaths:int,"
    "products:array<struct<type:string,productMake:string,productModel:string,productYear:string>>>"
)
RECALL_RECORD = (
    "struct<NHTSACampaignNumber:string,Make:string,Model:string,ModelYear:string,"
    "Manufacturer:string,Component:string,Summary:string,Consequence:string,Remedy:string,"
    "Notes:string,ReportReceivedDate:string,parkIt:boolean,parkOutSide:boolean,"
    "overTheAirUpdate:boolean>"
)
LISTING_RECORD = "struct<modelYear:string,make:string,model:string>"

# ``landed_seq`` counts responses in the order they were written; feeds landed before it was kept have none.
LANDING = "make string, query_model string, model_year int, status int, body string, landed_seq bigint"


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses under ``make=/query_model=/model_year=``; key columns come from the path."""
    return spark.read.schema(LANDING).json(path)


def triage(responses: DataFrame, message_chars: int | None = None) -> DataFrame:
    """Adds ``failure`` (NULL when usable), ``retryable`` and ``message``.

    The status decides; a body that claims success under a 4xx status is still a failure, and so is
    one without a status. Messages hold the whole body unless ``message_chars`` asks for a cut.
    """
    doc = F.try_parse_json("body")
    failure = first_true(
        (F.col("status").isNull(), "no_status"),
        (F.col("status") >= 500, "server_error"),
        (F.col("status") >= 400, "client_error"),
        (doc.isNull(), "not_json"),
        (F.try_variant_get(doc, "$.results", "array<variant>").isNull(), "no_results"),
    )
    detail = F.concat_ws(" ", failure, F.lit("status"), F.col("status").cast("string"), F.col("body"))
    return responses.select(
        "*",
        failure.alias("failure"),
        F.coalesce(F.col("status") >= 500, F.lit(False)).alias("retryable"),
    ).withColumn("message", F.when(F.col("failure").isNotNull(), clip(detail, message_chars)))


def opened(responses: DataFrame, record: str, *keys: str) -> DataFrame:
    """``(*keys, failure, records)``: every response triaged and, if usable, parsed, in one pass."""
    found = F.from_json("body", f"results array<{record}>")["results"]
    return triage(responses).select(*keys, "failure", F.when(F.col("failure").isNull(), found).alias("records"))


def open_envelope(responses: DataFrame, record: str, *keys: str) -> DataFrame:
    """``(*keys, rec_ord, record)``: one row per record of the usable responses.

    Usable is what :func:`triage` finds no failure in: a status below 400, and a results array. A body
    without one, or that is not JSON, parses to NULL and gives no row; a missing status is no status
    below 400.
    """
    results = F.from_json("body", f"results array<{record}>")["results"]
    usable = responses.filter(F.col("status") < 400)
    return usable.select(*keys, F.posexplode(results).alias("rec_ord", "record"))


def page_completeness(pages: DataFrame) -> DataFrame:
    """Per feed: pages landed, records, announced total, and whether the feed is whole.

    Input is ``(feed, body)``. A feed is whole when the records reach the total or when an
    empty page was landed.
    """
    env = F.from_json(
        "body", "meta struct<pagination:struct<total:bigint>>, results array<string>"
    )
    return (
        pages.select("feed", env.alias("e"))
        .groupBy("feed")
        .agg(
            F.count("*").alias("pages"),
            F.sum(F.coalesce(F.size("e.results"), F.lit(0))).alias("records"),
            F.max("e.meta.pagination.total").alias("total"),
            F.max(F.coalesce(F.size("e.results") == 0, F.lit(False))).alias("_saw_end"),
        )
        .select(
            "feed", "pages", "records", "total",
            F.coalesce(F.col("records") >= F.col("total"), F.lit(False)).__or__(F.col("_saw_end"))
            .alias("complete"),
        )
    )


def distinct_listing(listing: DataFrame) -> DataFrame:
    """Listing rows ``(ord, modelYear, make, model)`` without repeats, first one kept."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("modelYear", "make", "model")]
    return listing.groupBy(*keys).agg(F.min("ord").alias("ord"))


def work_list(models: DataFrame, years: Iterable[int]) -> DataFrame:
    """Every (make, model, model_year) of the configured models."""
    every = F.explode(F.array(*[F.lit(y) for y in years]))
    return models.select("make", "model", every.alias("model_year"))


def discover(work: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve configured models to listed names: ``(keys, gaps)``.

    A configured model keeps every listed variant; one without any is reported as a gap.
    """
    listed = listing.select(
        "make", F.col("modelYear").cast("int").alias("model_year"), F.col("model").alias("query_model")
    ).distinct()
    matched = (
        work.join(listed, ["make", "model_year"])
        .filter(names_variant(F.col("model"), F.col("query_model")))
    )
    keys = matched.select("make", "query_model", "model_year", F.col("model").alias("configured"))
    found = keys.select("make", F.col("configured").alias("model"), "model_year").distinct()
    return keys, work.join(found, ["make", "model", "model_year"], "left_anti")

"""Record normalisation with ordered, counted reject reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse import settings
from fieldpulse.functions.dates import feed_date
from fieldpulse.functions.text import is_blank, split_list, strip_ws
from fieldpulse.runtime import first_true

REPORT_COLUMNS = (
    "odi_number", "make", "model", "model_year", "components_coarse", "summary",
    "date_of_incident", "date_complaint_filed", "crash", "fire", "injuries", "deaths",
)
RECALL_COLUMNS = (
    "campaign_number", "make", "model", "model_year", "manufacturer", "component", "summary",
    "consequence", "remedy", "notes", "report_received_date", "park_it", "park_outside",
    "over_the_air_update",
)


def attribution(products: Column, make: Column) -> Column:
    """First vehicle product of the searched make with a model and an all-digit year."""

    def fits(p: Column) -> Column:
        return (
            (p["type"] == "Vehicle")
            & (F.upper(p["productMake"]) == F.upper(make))
            & ~is_blank(p["productModel"])
            & strip_ws(p["productYear"]).rlike("^[0-9]+$")
        )

    return F.get(F.filter(products, fits), F.lit(0))


def normalise_reports(records: DataFrame) -> DataFrame:
    """Complaint rows from ``(make, record, ...)``; other input columns pass through.

    ``reject_reason`` is NULL for a row that can be stored. The make is the searched one,
    model and year are the record's own; the partial VIN is not read.
    """
    r = F.col("record")
    staged = records.select(
        "*",
        attribution(r["products"], F.col("make")).alias("_vehicle"),
        feed_date(r["dateOfIncident"], settings.REPORT_DATE).alias("_incident"),
        feed_date(r["dateComplaintFiled"], settings.REPORT_DATE).alias("_filed"),
    )
    reason = first_true(
        (r["odiNumber"].isNull(), "missing_odi_number"),
        (is_blank(r["summary"]), "summary_missing"),
        (F.col("_vehicle").isNull(), "no_vehicle_attribution"),
        (~F.col("_incident.ok"), "incident_date_unparseable"),
        (~F.col("_filed.ok"), "filed_date_unparseable"),
    )
    carried = [c for c in records.columns if c not in ("record", "make")]
    return staged.select(
        *carried,
        r["odiNumber"].alias("odi_number"),
        "make",
        strip_ws(F.col("_vehicle.productModel")).alias("model"),
        strip_ws(F.col("_vehicle.productYear")).try_cast("int").alias("model_year"),
        split_list(r["components"]).alias("components_coarse"),
        strip_ws(r["summary"]).alias("summary"),
        F.col("_incident.value").alias("date_of_incident"),
        F.col("_filed.value").alias("date_complaint_filed"),
        r["crash"].alias("crash"),
        r["fire"].alias("fire"),
        r["numberOfInjuries"].alias("injuries"),
        r["numberOfDeaths"].alias("deaths"),
        reason.alias("reject_reason"),
    )


def _or_searched(value: Column, searched: Column) -> Column:
    """The record's value unless it is NULL or empty; white space alone counts as a value."""
    return F.upper(strip_ws(F.when(F.length(value) > 0, value).otherwise(searched)))


def normalise_recalls(records: DataFrame) -> DataFrame:
    """Recall rows from ``(make, model, model_year, record, ...)`` with ``reject_reason``."""
    r = F.col("record")
    year_text = F.when((F.length(r["ModelYear"]) > 0) & (r["ModelYear"] != "0"), strip_ws(r["ModelYear"]))
    year = F.coalesce(year_text, F.col("model_year").cast("string")).try_cast("int")
    received = feed_date(r["ReportReceivedDate"], settings.RECALL_DATE)
    campaign = strip_ws(F.coalesce(r["NHTSACampaignNumber"], F.lit("")))
    reason = first_true(
        (campaign == "", "missing_campaign_number"),
        (~received["ok"], "report_date_unparseable"),
        (year.isNull(), "model_year_invalid"),
    )
    carried = [c for c in records.columns if c not in ("record", "make", "model", "model_year")]
    return records.select(
        *carried,
        campaign.alias("campaign_number"),
        _or_searched(r["Make"], F.col("make")).alias("make"),
        _or_searched(r["Model"], F.col("model")).alias("model"),
        year.alias("model_year"),
        r["Manufacturer"].alias("manufacturer"),
        r["Component"].alias("component"),
        r["Summary"].alias("summary"),
        r["Consequence"].alias("consequence"),
        r["Remedy"].alias("remedy"),
        r["Notes"].alias("notes"),
        received["value"].alias("report_received_date"),
        r["parkIt"].alias("park_it"),
        r["parkOutSide"].alias("park_outside"),
        r["overTheAirUpdate"].alias("over_the_air_update"),
        reason.alias("reject_reason"),
    )


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def reject_counts(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("reject_reason").isNotNull())
        .groupBy("reject_reason")
        .agg(F.count("*").alias("n"))
    )


def ingest_bounds(
    reports: DataFrame,
    today: str,
    history_start: str = settings.HISTORY_START,
    holdback_days: int = settings.HOLDBACK_DAYS,
    earliest_incident: str = settings.EARLIEST_INCIDENT,
    min_chars: int = settings.MIN_SUMMARY_CHARS,
) -> DataFrame:
    """Adds ``bound`` (NULL when inside all of them): the documented ingest limits."""
    until = F.date_sub(F.lit(today).cast("date"), holdback_days)
    return reports.withColumn(
        "bound",
        first_true(
            (F.col("date_complaint_filed") < F.lit(history_start).cast("date"), "before_history"),
            (F.col("date_complaint_filed") > until, "held_back"),
            (
                (F.col("date_of_incident") < F.lit(earliest_incident).cast("date"))
                | (F.col("date_of_incident") > F.lit(today).cast("date")),
                "implausible_incident_date",
            ),
            (F.length("summary") < min_chars, "summary_too_short"),
        ),
    )

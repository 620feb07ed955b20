"""Feeds: delimited scan, landed responses, listings, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse import settings
from fieldpulse.catalog import bindings as b
from fieldpulse.catalog.registry import query
from fieldpulse.operators.merge import RECALL_KEY, arrivals, last_wins
from fieldpulse.operators.normalise import (
    accepted,
    ingest_bounds,
    normalise_recalls,
    normalise_reports,
    reject_counts,
)
from fieldpulse.plans.profile import ingest_report, mentions
from fieldpulse.runtime import as_table, scratch_path, spread
from fieldpulse.sources import flat, landed

# --- delimited feed -------------------------------------------------------------------

_FAMILY = tuple((m, f"NATION_{n}") for m in ("HOUSEHOLD", "MACHINERY", "FURNITURE") for n in (1, 2, 7, 20))
_YEARS = (1996, 1997, 1998, 1999)


def flat_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines in the 51-column text shape of the delimited feed."""
    customer = b.table(spark, sf, "customer").join(
        b.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name")
    orders = b.table(spark, sf, "orders").join(customer, "o_custkey")
    parts = b.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name")
    rows = (
        spread(b.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus"), "l_orderkey")
        .withColumnRenamed("l_orderkey", "o_orderkey")
        .join(parts, "l_partkey")
        .join(orders, "o_orderkey")
    )
    status, priority, on = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderdate")
    values = {
        "ODINO": F.col("o_orderkey").cast("string"),
        "MAKETXT": F.lower("c_mktsegment"),
        "MODELTXT": F.concat(
            "n_name", F.when(status == "F", " HYBRID").when(status == "O", "X").otherwise("")
        ),
        "YEARTXT": F.when(priority == "5-LOW", "n/a").otherwise(F.year(on).cast("string")),
        "CRASH": F.when(status == "F", "Y").when(status == "O", "N"),
        "FIRE": F.when(priority == "1-URGENT", "Y").otherwise("N"),
        "FAILDATE": F.when(priority == "2-HIGH", "20221399").otherwise(F.date_format(on, "yyyyMMdd")),
        "LDATE": F.date_format(F.date_add(on.cast("date"), 30), "yyyyMMdd"),
        "INJURED": F.when(status == "P", "2").otherwise("x"),
        "COMPDESC": F.concat(F.lit(" "), "p_type", F.lit(": "), "p_name", F.lit(" ")),
        "VIN": F.lit("withheld"),
        "CDESCR": F.when(
            priority != "4-NOT SPECIFIED", F.concat(F.lit('Owner said "'), "n_name", F.lit('" again'))
        ),
        "PROD_TYPE": F.when(F.col("l_linestatus") == "O", "V").otherwise("T"),
    }
    return rows.select(
        *[values.get(c, F.lit(None).cast("string")).alias(c) for c in settings.FLAT_FIELDS]
    )


_FLAT_SQL = """
raw as (
  select o_orderkey as odi_number, lower(c_mktsegment) as make,
         n_name || case o_orderstatus when 'F' then ' HYBRID' when 'O' then 'X' else '' end as model,
         year(o_orderdate) as model_year, p_type || ': ' || p_name as component, p_type as coarse, o_orderstatus,
         o_orderpriority, o_orderdate::date as d, n_name, l_linestatus = 'O' as is_vehicle,
         l_linestatus = 'O' and o_orderpriority <> '5-LOW' and year(o_orderdate) in (1996, 1997, 1998, 1999)
           and c_mktsegment in ('HOUSEHOLD', 'MACHINERY', 'FURNITURE')
           and n_name in ('NATION_1', 'NATION_2', 'NATION_7', 'NATION_20') and o_orderstatus <> 'O' as in_scope
  from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey
       join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey)"""


@query(
    "backfill_flat_file",
    f"""with {_FLAT_SQL}
select odi_number, make, model, model_year::bigint as model_year,
       array_to_string(list_sort(list_distinct(list(component))), '|') as components,
       array_to_string(list_sort(list_distinct(list(coarse))), '|') as components_coarse,
       'Owner said "' || n_name || '" again' as summary,
       case when o_orderpriority <> '2-HIGH' then d end as date_of_incident,
       (d + interval 30 day)::date as date_complaint_filed,
       case o_orderstatus when 'F' then true when 'O' then false end as crash,
       o_orderpriority = '1-URGENT' as fire, case when o_orderstatus = 'P' then 2 end::bigint as injuries
from raw where in_scope and o_orderpriority <> '4-NOT SPECIFIED'
group by odi_number, make, model, model_year, o_orderstatus, o_orderpriority, d, n_name""",
)
def backfill_flat_file(spark: SparkSession, sf: str) -> DataFrame:
    """Write the feed as tab-separated text, scan it back, collapse it."""
    path = scratch_path(spark, "flat")
    (
        flat_rows(spark, sf).write.option("sep", "\t").option("quote", "").option("escape", "\\")
        .option("emptyValue", "").csv(path)
    )
    return _shown(flat.collapse(flat.read_flat(spark, path), _FAMILY, _YEARS))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        "odi_number", "make", "model", F.col("model_year").cast("bigint").alias("model_year"),
        F.array_join("components", "|").alias("components"),
        F.array_join("components_coarse", "|").alias("components_coarse"),
        "summary", "date_of_incident", "date_complaint_filed", "crash", "fire",
        F.col("injuries").cast("bigint").alias("injuries"),
    )


@query(
    "backfill_funnel",
    f"""with {_FLAT_SQL}
select count(*) as rows_loaded, count(*) filter (where is_vehicle) as rows_vehicles,
       count(*) filter (where in_scope) as rows_scoped,
       count(distinct odi_number) filter (where in_scope and o_orderpriority <> '4-NOT SPECIFIED') as complaints_deduped,
       count(distinct odi_number) filter (where in_scope and o_orderpriority <> '4-NOT SPECIFIED') as written
from raw""",
)
def backfill_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the feed beside the rows of the table that the backfill wrote, read back."""
    rows = flat_rows(spark, sf)
    return flat.funnel(rows, _FAMILY, _YEARS, written=as_table(flat.collapse(rows, _FAMILY, _YEARS), "complaints"))


@query(
    "landing_folders",
    """select c_mktsegment as make, 'NATION ' || c_nationkey as query_model, year(o_orderdate)::int as model_year, count(*) as records,
       min(o_orderkey) as first_number
from orders join customer on c_custkey = o_custkey
where c_nationkey > 3 and not (o_orderstatus = 'P' and o_orderpriority = '5-LOW') group by all""",
)
def landing_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Responses landed in a folder for every vehicle and year; the keys come back from the folders' names."""
    path = scratch_path(spark, "folders")
    vehicles = responses(spark, sf).drop("key_ord")
    vehicles.repartition("make", "query_model", "model_year").write.partitionBy("make", "query_model", "model_year").json(path)
    records = landed.open_envelope(
        landed.read_landing(spark, path), landed.REPORT_RECORD, "make", "query_model", "model_year"
    )
    number = F.col("record.odiNumber")
    return records.filter(number.isNotNull()).groupBy("make", "query_model", "model_year").agg(
        F.count("*").alias("records"), F.min(number).alias("first_number")
    )


@query(
    "family_filter",
    """select p_partkey from part
where (p_type = 'SMALL' and (p_name = 'red' or p_name like 'red %'))
   or (p_type = 'LARGE' and (p_name = 'old rod' or p_name like 'old rod %' or p_name like 'hot %'))
   or (p_type = 'PROMO' and p_name = 'ring')""",
)
def family_filter(spark: SparkSession, sf: str) -> DataFrame:
    chosen = (("small", "Red"), ("Large", "old rod"), ("LARGE", "hot"), ("PROMO", "ring"))
    return b.table(spark, sf, "part").filter(
        flat.in_family(F.col("p_type"), F.col("p_name"), chosen)
    ).select("p_partkey")


# --- landed responses --------------------------------------------------------------------


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """One landed response per order, with the failures and bad records real feeds show."""
    rows = spread(b.table(spark, sf, "orders"), "o_orderkey").join(
        b.table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")
    )
    status, priority, on = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderdate")
    is_open, is_part = status == "O", status == "P"
    product = lambda kind, model, year: F.struct(
        F.lit(kind).alias("type"), F.lower("c_mktsegment").alias("productMake"),
        model.alias("productModel"), year.alias("productYear"),
    )
    year = F.when((status == "F") & (priority == "5-LOW"), "20x2").otherwise(F.year(on).cast("string"))
    tyre = product("Tire", F.lit("T"), F.lit("1990"))
    car = product("Vehicle", F.concat(F.lit(" NATION "), F.col("c_nationkey").cast("string"), F.lit(" ")), year)
    no_car = (status == "F") & (priority == "1-URGENT")
    record = F.struct(
        F.when(is_open & (priority == "3-MEDIUM"), "   ")
        .otherwise(F.concat(F.lit("  Order of "), "c_name", F.lit(" ")))
        .alias("summary"),
        F.when(is_part & (priority == "2-HIGH"), "13/45/2022")
        .when(is_part & (priority == "3-MEDIUM"), "")
        .otherwise(F.date_format(on, "MM/dd/yyyy"))
        .alias("dateOfIncident"),
        F.when(is_part & (priority == "1-URGENT"), "x")
        .otherwise(F.date_format(F.date_add(on.cast("date"), 30), "M/d/yyyy"))
        .alias("dateComplaintFiled"),
        F.concat(F.lit("STATUS "), status, F.lit(" ,PRIORITY "), priority, F.lit(",, PRIORITY "), priority)
        .alias("components"),
        F.when(status != "P", status == "F").alias("crash"),
        F.lit(1).alias("numberOfInjuries"),
        F.when(no_car, F.array(tyre)).otherwise(F.array(tyre, car)).alias("products"),
    )
    # The number arrives as text in some records, which does not count as a number.
    number = F.when(
        is_part & (priority == "5-LOW"), F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('"'))
    ).otherwise(F.col("o_orderkey").cast("string"))
    body = F.concat(
        F.lit('{"count":1,"message":"Results returned successfully","results":[{"odiNumber":'), number,
        F.lit(","), F.substr(F.to_json(record), F.lit(2)), F.lit("]}"),
    )
    nation = F.col("c_nationkey")
    return rows.select(
        F.col("c_mktsegment").alias("make"),
        F.concat(F.lit("NATION "), nation.cast("string")).alias("query_model"),
        F.year(on).alias("model_year"),
        F.col("o_orderkey").alias("key_ord"),
        F.when(nation == 0, 500).when(nation == 1, 404).otherwise(200).alias("status"),
        F.when(nation == 2, "<html>busy</html>")
        .when(nation == 3, '{"count":0,"message":"none"}')
        .otherwise(body)
        .alias("body"),
    )


LANDED_SQL = """
landed as (
  select c_mktsegment as make, c_nationkey as nation, o.*, c_name, o_orderdate::date as d,
         case c_nationkey when 0 then 'server_error' when 1 then 'client_error' when 2 then 'not_json'
                          when 3 then 'no_results' end as failure
  from orders o join customer on c_custkey = o_custkey),
records as (
  select *, case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then 'missing_odi_number'
       when o_orderstatus = 'O' and o_orderpriority = '3-MEDIUM' then 'summary_missing'
       when o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '5-LOW') then 'no_vehicle_attribution'
       when o_orderstatus = 'P' and o_orderpriority = '2-HIGH' then 'incident_date_unparseable'
       when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then 'filed_date_unparseable' end as reject_reason
  from landed where failure is null)"""


def _normalised(spark: SparkSession, sf: str) -> DataFrame:
    records = landed.open_envelope(
        responses(spark, sf), landed.REPORT_RECORD, "make", "query_model", "key_ord"
    )
    return normalise_reports(records)


@query(
    "landing_triage",
    f"""with {LANDED_SQL}
select make, coalesce(failure, 'ok') as outcome, coalesce(failure = 'server_error', false) as retryable, count(*) as n
from landed group by all""",
)
def landing_triage(spark: SparkSession, sf: str) -> DataFrame:
    return (
        landed.triage(responses(spark, sf))
        .groupBy("make", F.coalesce("failure", F.lit("ok")).alias("outcome"), "retryable")
        .agg(F.count("*").alias("n"))
    )


@query(
    "landing_messages",
    f"""with {LANDED_SQL},
marked as (
  select o_orderkey, nation, case when nation = 5 then 'no_status' else failure end as failure,
         case nation when 0 then ' status 500' when 1 then ' status 404' when 5 then ' status' else ' status 200' end as said,
         case nation when 2 then ' <html>busy</html>' when 3 then ' {{"count":0,"message":"none"}}' end as body
  from landed)
select o_orderkey, coalesce(failure, 'ok') as outcome, failure = 'server_error' as retryable,
       case when nation in (2, 3) then failure || said || body end as message, failure in ('no_status', 'ok') as has_body
from (select * replace (coalesce(failure, 'ok') as failure) from marked)""",
)
def landing_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Triage with responses that were landed without a status; short messages are shown whole."""
    rows = responses(spark, sf).withColumn(
        "status", F.when(F.col("query_model") != "NATION 5", F.col("status"))
    )
    triaged = landed.triage(rows)
    plain = F.col("failure").isin("not_json", "no_results")
    return triaged.select(
        F.col("key_ord").alias("o_orderkey"), F.coalesce("failure", F.lit("ok")).alias("outcome"), "retryable",
        F.when(plain, F.col("message")).alias("message"),
        (F.col("failure").isNull() | (F.col("failure") == "no_status")).alias("has_body"),
    )


@query(
    "normalise_reports",
    f"""with {LANDED_SQL}
select o_orderkey as odi_number, make, 'NATION ' || nation as model, year(o_orderdate)::bigint as model_year,
       'PRIORITY ' || o_orderpriority || '|STATUS ' || o_orderstatus as components_coarse,
       'Order of ' || c_name as summary,
       case when o_orderstatus = 'P' and o_orderpriority = '3-MEDIUM' then null else d end as date_of_incident,
       (d + interval 30 day)::date as date_complaint_filed,
       case when o_orderstatus <> 'P' then o_orderstatus = 'F' end as crash, 1::bigint as injuries
from records where reject_reason is null""",
)
def normalised_reports(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(_normalised(spark, sf)).select(
        "odi_number", "make", "model", F.col("model_year").cast("bigint").alias("model_year"),
        F.array_join("components_coarse", "|").alias("components_coarse"), "summary",
        "date_of_incident", "date_complaint_filed", "crash", F.col("injuries").cast("bigint").alias("injuries"),
    )


@query(
    "normalise_rejects",
    f"with {LANDED_SQL} select reject_reason, count(*) as n from records where reject_reason is not null group by 1",
)
def normalise_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return reject_counts(_normalised(spark, sf))


@query(
    "ingest_report",
    f"""with {LANDED_SQL},
good as (select *, o_orderstatus = 'F' as known from records where reject_reason is null)
select 'keys_attempted' as metric, '' as detail, count(*) as n from landed
union all select 'keys_failed', '', count(failure) from landed
union all select 'fetched', '', count(*) from records
union all select 'distinct', '', count(*) from good
union all select 'inserted', '', count(*) from good where not known
union all select 'refreshed', '', count(*) from good where known
union all select 'dropped', reject_reason, count(*) from records where reject_reason is not null group by 2
union all select 'model_seen', make || ' NATION ' || nation, count(*) from good group by 2""",
)
def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    # Every body is triaged and parsed once, and every record normalised once.
    opened = as_table(landed.opened(responses(spark, sf), landed.REPORT_RECORD, "make", "query_model", "key_ord"), "opened")
    records = opened.select("make", "query_model", "key_ord", F.posexplode("records").alias("rec_ord", "record"))
    rows = as_table(normalise_reports(records), "normalised")
    unique = last_wins(accepted(rows), ["odi_number"], ["key_ord", "rec_ord"])
    stored = b.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("odi_number")
    )
    return ingest_report(
        rows, arrivals(stored, unique, ["odi_number"]), opened
    )


@query(
    "ingest_bounds",
    """select bound, count(*) as n from (
  select case when d + 30 < date '1996-01-01' then 'before_history' when d + 30 > date '2000-12-01' then 'held_back'
              when d < date '1996-03-01' then 'implausible_incident_date'
              when length('Order ' || o_orderkey || ' ' || o_orderpriority) < 16 then 'summary_too_short'
              else 'inside' end as bound
  from (select *, o_orderdate::date as d from orders)) group by 1""",
)
def bounded(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest_bounds(
        b.reports(spark, sf, components=False), "2000-12-31", "1996-01-01", 30, "1996-03-01", 16
    )
    return rows.groupBy(F.coalesce("bound", F.lit("inside")).alias("bound")).agg(F.count("*").alias("n"))


_RECALL_SQL = """
notices as (
  select *, case when p_size < 10 then 'SEARCHED' else p_type end as make, upper(p_name) as model,
         case when p_size < 5 then '2010' when p_size = 7 then null else (2000 + p_size)::varchar end as model_year,
         case when p_type = 'PROMO' then 'missing_campaign_number'
              when p_size > 28 then 'report_date_unparseable'
              when p_size = 7 then 'model_year_invalid' end as reject_reason
  from part)"""


def recall_records(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    record = F.struct(
        F.when(F.col("p_type") == "PROMO", "  ").otherwise(F.col("p_brand")).alias("NHTSACampaignNumber"),
        F.when(size >= 10, F.lower("p_type")).when(size >= 5, "").alias("Make"),
        F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("Model"),
        F.when(size < 5, "0").when(size == 7, "20x7").otherwise((size + 2000).cast("string")).alias("ModelYear"),
        F.concat(size.cast("string"), F.lit("/2/2022")).alias("ReportReceivedDate"),
        (F.col("p_type") == "SMALL").alias("parkIt"),
    )
    body = F.concat(F.lit('{"Count":1,"Message":"","results":['), F.to_json(record), F.lit("]}"))
    rows = b.table(spark, sf, "part").select(
        F.lit("searched").alias("make"), F.lit("any").alias("model"), F.lit(2010).alias("model_year"),
        "p_partkey", F.lit(200).alias("status"), body.alias("body"),
    )
    return landed.open_envelope(
        rows, landed.RECALL_RECORD, "make", "model", "model_year", "p_partkey"
    )


@query(
    "normalise_recalls",
    f"""with {_RECALL_SQL}
select p_partkey, p_brand as campaign_number, make, model, model_year::bigint as model_year,
       make_date(2022, 2, p_size) as report_received_date, p_type = 'SMALL' as park_it
from notices where reject_reason is null""",
)
def normalised_recalls(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(normalise_recalls(recall_records(spark, sf))).select(
        "p_partkey", "campaign_number", "make", "model", F.col("model_year").cast("bigint").alias("model_year"),
        "report_received_date", "park_it",
    )


@query(
    "recall_rejects",
    f"with {_RECALL_SQL} select reject_reason, count(*) as n from notices where reject_reason is not null group by 1",
)
def recall_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return reject_counts(normalise_recalls(recall_records(spark, sf)))


@query(
    "recall_ingest_report",
    f"""with {_RECALL_SQL},
good as (
  select make, model, p_size >= 10 as fresh, count(*) as n
  from notices where reject_reason is null group by p_brand, make, model, model_year, p_size >= 10)
select 'keys_attempted' as metric, '' as detail, count(*) as n from part
union all select 'keys_failed', '', 0
union all select 'fetched', '', count(*) from part
union all select 'distinct', '', count(*) from good
union all select 'inserted', '', count(*) from good where fresh
union all select 'refreshed', '', count(*) from good where not fresh
union all select 'dropped', reject_reason, count(*) from notices where reject_reason is not null group by 2
union all select 'model_seen', make || ' ' || model, count(*) from good group by 2""",
)
def recall_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Recalls named after the searched make are stored already."""
    rows = as_table(normalise_recalls(recall_records(spark, sf)), "normalised")
    unique = last_wins(accepted(rows), RECALL_KEY, ["p_partkey"])
    stored = unique.filter(F.col("make") == "SEARCHED").select(*RECALL_KEY)
    landed_parts = b.table(spark, sf, "part").select(F.lit(None).cast("string").alias("failure"))
    return ingest_report(rows, arrivals(stored, unique, RECALL_KEY), landed_parts)


# --- listings and pages ------------------------------------------------------------------


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), (F.col("p_size") + 2000).cast("string").alias("modelYear"),
        F.col("p_type").alias("make"), F.concat_ws("  ", F.split("p_name", " ")).alias("model"),
    )
    return landed.distinct_listing(rows)


@query(
    "distinct_listing",
    """select (p_size + 2000)::varchar as "modelYear", p_type as make, replace(p_name, ' ', '  ') as model,
       min(p_partkey) as ord from part group by all""",
)
def distinct_listing(spark: SparkSession, sf: str) -> DataFrame:
    return _listing(spark, sf)


_DISCOVER_YEARS = (2003, 2008, 2013, 2021, 2034)

_DISCOVER_SQL = """
work as (
  select distinct p_type as make, string_split(p_name, ' ')[1] as model, y::bigint as model_year
  from part, (select unnest([2003, 2008, 2013, 2021, 2034]) as y)),
found as (
  select distinct w.make, w.model, w.model_year, replace(p_name, ' ', '  ') as query_model
  from work w join part on p_type = w.make and p_size + 2000 = w.model_year and p_name like w.model || ' %')"""


def _discover(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    models = b.table(spark, sf, "part").select(
        F.col("p_type").alias("make"), F.split("p_name", " ")[0].alias("model")
    ).distinct()
    return landed.discover(landed.work_list(models, _DISCOVER_YEARS), _listing(spark, sf))


@query(
    "discover_keys",
    f"with {_DISCOVER_SQL} select make, query_model, model_year, model as configured from found",
)
def discover_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _discover(spark, sf)[0].withColumn("model_year", F.col("model_year").cast("bigint"))


@query(
    "discover_gaps",
    f"with {_DISCOVER_SQL} select make, model, model_year from work anti join found using (make, model, model_year)",
)
def discover_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return _discover(spark, sf)[1].withColumn("model_year", F.col("model_year").cast("bigint"))


@query(
    "page_completeness",
    """select conv_id as feed, count(*) as pages, count(*) filter (where role = 'user') as records,
       max(turn)::bigint as total,
       count(*) filter (where role = 'user') >= max(turn) or bool_or(role <> 'user') as complete
from conversations group by 1""",
)
def page_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """One page per turn: a user turn carries one record, any other page is empty."""
    turns = b.table(spark, sf, "conversations")
    results = F.when(F.col("role") == "user", F.array("role")).otherwise(F.array().cast("array<string>"))
    page = F.struct(
        F.struct(F.struct(F.col("turn").alias("total")).alias("pagination")).alias("meta"),
        results.alias("results"),
    )
    return landed.page_completeness(
        turns.select(F.col("conv_id").alias("feed"), F.to_json(page).alias("body"))
    )


@query(
    "component_mentions",
    f"with {b.SQL_REPORTS} select odi_number, make from reports where list_contains(components, 'PROMO: hot bolt')",
)
def component_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(b.reports(spark, sf), "PROMO: hot bolt").select("odi_number", "make")

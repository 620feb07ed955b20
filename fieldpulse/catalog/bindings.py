"""How the shared test tables play the roles of the data model.

``orders`` are reports (priority = make, status = model, the parts of their lines =
components), ``customer`` rows are patterns with their orders as members, ``embeddings`` are
report vectors (``vec_id`` = order key), and ``part`` rows are published recalls. Every
role covers its whole table. The SQL texts state the same roles for the check.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldpulse.functions.text import coarse_components
from fieldpulse.operators.merge import last_wins

TODAY = dt.date(1999, 6, 30)
RECENT, BASELINE = 365, 1095


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Base table with its zone-less timestamps read as UTC instants.

    The schema is looked up once per table; later reads declare it and start no job.
    """
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_SCHEMAS[path]).parquet(path)
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def day(name: str):
    return F.col(name).cast("date")


def order_components(spark: SparkSession, sf: str, wanted: DataFrame | None = None) -> DataFrame:
    """``(odi_number, components)``: sorted distinct part descriptions of an order's lines.

    ``wanted (odi_number)`` are the orders whose components are asked for; lines of others go before names come to them.
    """
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat("p_type", F.lit(": "), "p_name").alias("component"),
    )
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    if wanted is not None:
        lines = lines.join(wanted.select(F.col("odi_number").alias("l_orderkey")), "l_orderkey", "left_semi")
    return lines.join(parts, "l_partkey").groupBy(F.col("l_orderkey").alias("odi_number")).agg(
        F.array_sort(F.collect_set("component")).alias("components")
    )


SQL_COMPONENTS = """
comp as (
  select l_orderkey as odi_number,
         list_sort(list_distinct(list(p_type || ': ' || p_name))) as components,
         list_sort(list_distinct(list(p_type))) as components_coarse
  from lineitem join part on p_partkey = l_partkey group by 1)"""


def reports(spark: SparkSession, sf: str, components: bool = True) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("odi_number"),
        F.col("o_orderpriority").alias("make"),
        F.col("o_orderstatus").alias("model"),
        F.year("o_orderdate").alias("model_year"),
        day("o_orderdate").alias("date_of_incident"),
        F.date_add(day("o_orderdate"), 30).alias("date_complaint_filed"),
        F.concat_ws(" ", F.lit("Order"), "o_orderkey", "o_orderpriority").alias("summary"),
        F.when(
            F.col("o_orderstatus") == "F", F.concat(F.lit("Kept "), F.col("o_orderkey").cast("string"))
        ).alias("summary_stripped"),
    )
    if not components:
        return rows
    found = order_components(spark, sf)
    return rows.join(
        found.withColumn("components_coarse", coarse_components(F.col("components"))),
        "odi_number", "left",
    )


SQL_REPORTS = SQL_COMPONENTS + """,
reports as (
  select o_orderkey as odi_number, o_orderpriority as make, o_orderstatus as model,
         year(o_orderdate) as model_year, o_orderdate::date as date_of_incident,
         (o_orderdate + interval 30 day)::date as date_complaint_filed,
         'Order ' || o_orderkey || ' ' || o_orderpriority as summary,
         case when o_orderstatus = 'F' then 'Kept ' || o_orderkey end as summary_stripped,
         components, components_coarse
  from orders left join comp on odi_number = o_orderkey)"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pattern_id"),
        F.col("o_orderkey").alias("odi_number"),
        F.col("o_totalprice").alias("similarity"),
    )


def stored_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as stored patterns: verdict from the balance, state from the segment."""
    balance = F.col("c_acctbal")
    verdict = (
        F.when(balance < 0, None)
        .when(balance < 3000, "novel")
        .when(balance < 6000, "partially_covered")
        .otherwise("known")
    )
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "reviewed")
        .when(F.col("c_mktsegment") == "MACHINERY", "hidden")
        .otherwise("new")
        .alias("state"),
        verdict.alias("novelty_verdict"),
        F.when(
            balance >= 3000, F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 3).cast("string"))
        ).alias("novelty_recall_ref"),
        F.lit("2000-01-01 00:00:00").cast("timestamp").alias("updated_at"),
    )


SQL_PATTERNS = """
stored as (
  select c_custkey as id, c_name as name,
         case c_mktsegment when 'FURNITURE' then 'reviewed' when 'MACHINERY' then 'hidden'
              else 'new' end as state,
         case when c_acctbal < 0 then null when c_acctbal < 3000 then 'novel'
              when c_acctbal < 6000 then 'partially_covered' else 'known' end as novelty_verdict,
         case when c_acctbal >= 3000 then 'Brand#' || (c_nationkey + 3) end as novelty_recall_ref
  from customer)"""

SQL_SCORES = f"""
scores as (
  select c_custkey as id, coalesce(recent_count, 0) as recent_count,
         coalesce(baseline_count, 0) as baseline_count,
         case when baseline_count > 0
              then (recent_count / {RECENT}.0::double) / (baseline_count / {BASELINE}.0::double) end as ratio
  from customer left join (
    select o_custkey,
           count(*) filter (where d >= date '1998-06-30' and d <= date '1999-06-30') as recent_count,
           count(*) filter (where d >= date '1995-07-01' and d < date '1998-06-30') as baseline_count
    from (select o_custkey, o_orderdate::date as d from orders) group by 1) on o_custkey = c_custkey),
scored as (
  select *, case when ratio is null then null when ratio >= 4 then 'high' when ratio >= 2 then 'medium'
                 when ratio >= 1 then 'low' else 'none' end as severity
  from scores)"""


def recalls(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as recalls, one row per key: the last part of each key."""
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("campaign_number"),
        F.col("p_type").alias("make"),
        F.col("p_name").alias("model"),
        (F.col("p_size") + 2000).alias("model_year"),
        F.concat_ws(" ", "p_type", "p_name").alias("component"),
        F.concat_ws(" ", F.lit("Part"), "p_partkey").alias("summary"),
        F.when(F.col("p_size") > 25, F.lit("large")).alias("consequence"),
        F.lit(None).cast("string").alias("remedy"),
        F.lit(None).cast("date").alias("report_received_date"),
        F.col("p_partkey"),
        F.col("p_size"),
    )
    return last_wins(rows, ["campaign_number", "make", "model", "model_year"], ["p_partkey"])


SQL_RECALLS = """
recalls as (
  select * from (
    select p_brand as campaign_number, p_type as make, p_name as model, p_size + 2000 as model_year,
           p_type || ' ' || p_name as component, 'Part ' || p_partkey as summary,
           case when p_size > 25 then 'large' end as consequence, p_partkey, p_size,
           row_number() over (partition by p_brand, p_type, p_name, p_size order by p_partkey desc) as rn
    from part) where rn = 1)"""

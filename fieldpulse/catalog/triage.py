"""Scoring and the relational inbox over ``customer``, ``orders`` and ``events``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse import settings
from fieldpulse.catalog import bindings as b
from fieldpulse.catalog.registry import query
from fieldpulse.functions.labels import category_label
from fieldpulse.plans import delay
from fieldpulse.plans import inbox as views
from fieldpulse.plans.novelty import batch
from fieldpulse.plans.scoring import (
    cohorts,
    filing_lag,
    rate_curve,
    score_patterns,
    scoring_report,
)
from fieldpulse.runtime import as_table


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return score_patterns(
        b.stored_patterns(spark, sf), b.members(spark, sf), b.reports(spark, sf, components=False),
        b.TODAY, b.RECENT, b.BASELINE,
    )


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Stored patterns with sizes and scores, as the inbox reads them."""
    sizes = b.members(spark, sf).groupBy(F.col("pattern_id").alias("id")).agg(
        F.count("*").alias("member_count")
    )
    return (
        b.stored_patterns(spark, sf)
        .join(sizes, "id", "left")
        .withColumn("member_count", F.coalesce("member_count", F.lit(0).cast("bigint")))
        .join(_scores(spark, sf), "id")
    )


_SQL_PATTERNS = f"""{b.SQL_PATTERNS}, {b.SQL_SCORES},
patterns as (
  select s.*, coalesce(n, 0) as member_count, recent_count, baseline_count, ratio, severity
  from stored s join scored using (id) left join (
    select o_custkey as id, count(*) as n from orders group by 1) using (id))"""


@query(
    "score_patterns",
    f"with {b.SQL_SCORES} select id, recent_count, baseline_count, round(ratio, 6) as ratio, severity from scored",
)
def scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).withColumn("ratio", F.round("ratio", 6))


@query(
    "scoring_report",
    f"""with {b.SQL_SCORES} select count(*) as patterns_scored, count(ratio) as patterns_with_ratio,
count(*) filter (where baseline_count = 0) as patterns_baseline_zero from scored""",
)
def score_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scoring_report(_scores(spark, sf))


@query(
    "score_events",
    """with hits as (
  select user_id as id, ts::date as d from events),
counts as (
  select id, count(*) filter (where d >= date '2024-01-22' and d <= date '2024-01-29') as recent_count,
         count(*) filter (where d >= date '2024-01-01' and d < date '2024-01-22') as baseline_count
  from hits group by 1)
select id, recent_count, baseline_count,
       round(case when baseline_count > 0 then (recent_count / 7.0::double) / (baseline_count / 21.0::double) end, 6) as ratio
from counts""",
)
def score_events(spark: SparkSession, sf: str) -> DataFrame:
    """Users as patterns, their events as reports, a 7-day window over a 21-day baseline."""
    events = b.table(spark, sf, "events")
    members = events.select(F.col("user_id").alias("pattern_id"), F.col("event_id").alias("odi_number"))
    reports = events.select(F.col("event_id").alias("odi_number"), b.day("ts").alias("date_of_incident"))
    users = events.select(F.col("user_id").alias("id")).distinct()
    return score_patterns(users, members, reports, dt.date(2024, 1, 29), 7, 21).select(
        "id", "recent_count", "baseline_count", F.round("ratio", 6).alias("ratio")
    )


_SQL_FACTS = """
rows as (
  select o_custkey as id, make || ' ' || model as vehicle, components_coarse
  from orders join reports on odi_number = o_orderkey),
fleet as (select id, vehicle, count(*) as n from rows group by all),
top_fleet as (select id, arg_min(vehicle, (-n, vehicle)) as vehicle, count(*) as vehicles from fleet group by 1),
kinds as (
  select id, category, count(*) as n from (
    select id, unnest(coalesce(components_coarse, ['UNCATEGORISED'])) as category from rows) group by all),
top_kind as (select id, arg_min(category, (-n, category)) as category from kinds group by 1),
inbox as (
  select p.*, t.vehicle, coalesce(t.vehicles, 0) as vehicles, k.category
  from patterns p left join top_fleet t using (id) left join top_kind k using (id))"""

_SURFACED = """novelty_verdict in ('novel', 'partially_covered')
  and (severity in ('medium', 'high') or severity is null) and state <> 'hidden'"""
_RANK = "(state = 'new') desc, ratio desc nulls last, member_count desc, id"
_COLUMNS = """id, name, member_count, recent_count, baseline_count, round(ratio, 6) as ratio, severity, state,
  novelty_verdict, novelty_recall_ref"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("ratio", F.round("ratio", 6))


@query(
    "inbox_surfaced",
    f"""with {b.SQL_REPORTS}, {_SQL_PATTERNS}, {_SQL_FACTS}
select {_COLUMNS}, vehicle, vehicles, category from (
  select * from inbox where {_SURFACED} order by {_RANK} limit 50)""",
)
def inbox_surfaced(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(views.inbox(_patterns(spark, sf), b.members(spark, sf), b.reports(spark, sf)))


@query(
    "inbox_all",
    f"""with {b.SQL_REPORTS}, {_SQL_PATTERNS}, {_SQL_FACTS}
select {_COLUMNS}, vehicle, vehicles, category from inbox""",
)
def inbox_all(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        views.inbox(
            _patterns(spark, sf), b.members(spark, sf), b.reports(spark, sf),
            where=views.in_view(everything=True, with_hidden=True), limit=None,
        )
    )


@query(
    "assessment_batch",
    f"""with {_SQL_PATTERNS.strip().rstrip(',')}
select id from (select s.id, row_number() over (order by ratio desc nulls last, s.id) as rn
                from stored s join scored using (id) where novelty_verdict is null) where rn <= 12""",
)
def assessment_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve patterns that a limited batch judges next: no verdict yet, highest ratio first."""
    return batch(_patterns(spark, sf), limit=12).select("id")


@query(
    "inbox_labels",
    f"""with {b.SQL_REPORTS}, {_SQL_PATTERNS}, {_SQL_FACTS}
select id, case when ratio is null then 'insufficient history' else printf('%.2f×', ratio) end as ratio_label,
       coalesce(severity, 'insufficient history') as severity_label,
       coalesce(severity, 'emerging') as severity_badge,
       case novelty_verdict when 'novel' then 'novel' when 'partially_covered' then 'partly covered'
            when 'known' then 'known recall' else 'unassessed' end as novelty_label,
       case when category is null then 'Uncategorised'
            else upper(category[1]) || lower(category[2:]) || ' *' end as category_label,
       coalesce(vehicle, name) as title
from inbox""",
)
def inbox_labels(spark: SparkSession, sf: str) -> DataFrame:
    return views.inbox_labels(
        views.inbox(
            _patterns(spark, sf), b.members(spark, sf), b.reports(spark, sf),
            where=views.in_view(everything=True, with_hidden=True), limit=None,
        )
    )


@query(
    "category_label",
    """select p_partkey, case p_type when 'STANDARD' then 'Engine' when 'PROMO' then 'Fuel / propulsion system'
       else string_split(p_name, ' ')[1][1].upper() || string_split(p_name, ' ')[1][2:] || '/'
            || string_split(p_name, ' ')[2][1].upper() || string_split(p_name, ' ')[2][2:] || ' *' end as label
from part""",
)
def category_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Known codes by part type; other parts show the title-case fallback on a slashed name."""
    raw = (
        F.when(F.col("p_type") == "STANDARD", "ENGINE")
        .when(F.col("p_type") == "PROMO", "FUEL/PROPULSION SYSTEM")
        .otherwise(F.upper(F.replace("p_name", F.lit(" "), F.lit("/"))))
    )
    return b.table(spark, sf, "part").select("p_partkey", category_label(raw).alias("label"))


@query(
    "view_counts",
    f"""with {_SQL_PATTERNS} select count(*) as total, least(count(*), 50)::bigint as shown from patterns where {_SURFACED}""",
)
def view_counts(spark: SparkSession, sf: str) -> DataFrame:
    return views.view_counts(_patterns(spark, sf))


@query(
    "pattern_detail",
    f"with {b.SQL_REPORTS}, {_SQL_PATTERNS}, {_SQL_FACTS} select {_COLUMNS}, category from inbox",
)
def pattern_detail(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        views.pattern_detail(_patterns(spark, sf), b.members(spark, sf), b.reports(spark, sf))
    )


@query(
    "member_listing",
    f"""with {b.SQL_REPORTS}
select o_custkey as pattern_id, odi_number, make, model, model_year::bigint as model_year, date_of_incident,
       o_totalprice as similarity, coalesce(summary_stripped, summary) as summary
from orders join reports on odi_number = o_orderkey""",
)
def member_listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.member_listing(b.members(spark, sf), b.reports(spark, sf, components=False))
    return rows.withColumn("model_year", F.col("model_year").cast("bigint"))


_SAMPLES = """with {reports}
select pattern_id, rank::bigint as rank, odi_number, text from (
  select o_custkey as pattern_id, odi_number, coalesce(summary_stripped, summary) as text,
         row_number() over (partition by o_custkey order by o_totalprice desc, odi_number) as rank
  from orders join reports on odi_number = o_orderkey) where rank <= {n}"""


def _samples(spark: SparkSession, sf: str, n: int) -> DataFrame:
    rows = views.sample_narratives(
        b.members(spark, sf), b.reports(spark, sf, components=False), n, chars=None
    )
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query("sample_narratives", _SAMPLES.format(reports=b.SQL_REPORTS, n=4))
def sample_narratives(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(spark, sf, settings.SAMPLE_SUMMARIES)


@query("detail_narratives", _SAMPLES.format(reports=b.SQL_REPORTS, n=5))
def detail_narratives(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(spark, sf, settings.DETAIL_SUMMARIES)


@query(
    "recall_lookup",
    f"""with {b.SQL_PATTERNS}, {b.SQL_RECALLS},
first as (
  select * from (select *, row_number() over (partition by campaign_number order by make, model, model_year) as k
                 from recalls) where k = 1)
select s.id, novelty_recall_ref as campaign_number, f.campaign_number is not null as found, f.component,
       f.summary, f.consequence
from stored s left join first f on f.campaign_number = novelty_recall_ref where novelty_recall_ref is not null""",
)
def recall_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return views.recall_lookup(b.stored_patterns(spark, sf), b.recalls(spark, sf)).select(
        "id", "campaign_number", "found", "component", "summary", "consequence"
    )


@query(
    "rate_curve",
    """select o_custkey as pattern_id, date_trunc('month', o_orderdate)::date as period, count(*) as reports
from orders group by all""",
)
def rates(spark: SparkSession, sf: str) -> DataFrame:
    return rate_curve(b.members(spark, sf), b.reports(spark, sf, components=False))


@query(
    "cohorts",
    """select o_custkey as pattern_id, year(o_orderdate)::bigint as model_year, count(*) as reports,
       min(o_orderdate)::date as first_incident, max(o_orderdate)::date as last_incident
from orders group by all""",
)
def year_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    return cohorts(b.members(spark, sf), b.reports(spark, sf, components=False)).withColumn(
        "model_year", F.col("model_year").cast("bigint")
    )


@query(
    "filing_lag",
    """select o_orderpriority as make, count(*) as reports, round(avg(lag), 6) as mean_days,
       min(lag)::bigint as min_days, max(lag)::bigint as max_days
from (select o_orderpriority, date_diff('day', o_orderdate::date, l_shipdate::date) as lag
      from lineitem join orders on o_orderkey = l_orderkey) group by 1""",
)
def lag(spark: SparkSession, sf: str) -> DataFrame:
    """A line's shipping day as the filing of its order's incident."""
    rows = (
        b.table(spark, sf, "lineitem")
        .select("l_orderkey", b.day("l_shipdate").alias("date_complaint_filed"))
        .join(
            b.table(spark, sf, "orders").select(
                F.col("o_orderkey").alias("l_orderkey"),
                F.col("o_orderpriority").alias("make"),
                b.day("o_orderdate").alias("date_of_incident"),
            ),
            "l_orderkey",
        )
    )
    return filing_lag(rows, "make").select(
        "make", "reports", F.round("mean_days", 6).alias("mean_days"),
        F.col("min_days").cast("bigint").alias("min_days"), F.col("max_days").cast("bigint").alias("max_days"),
    )


_START, _AS_OF, _DAYS = dt.date(1995, 1, 1), dt.date(1998, 6, 30), 30
_WINDOWS = ((_AS_OF - _START).days + 1) // _DAYS
_TRIANGLE = f"""
filings as (
  select o_orderpriority as make, floor(date_diff('day', date '{_START}', o_orderdate::date) / {_DAYS}.0)::int as origin,
         floor(date_diff('day', date '{_START}', l_shipdate::date) / {_DAYS}.0)::int as filed
  from lineitem join orders on o_orderkey = l_orderkey),
cells as (
  select make, o.origin, d.delay,
         (select count(*) from filings f where f.make = m.make and f.origin = o.origin and f.filed = o.origin + d.delay) as n
  from (select distinct make from filings) m, (select unnest(range({_WINDOWS}))::int as origin) o,
       (select unnest(range({_WINDOWS}))::int as delay) d
  where o.origin + d.delay < {_WINDOWS}),
triangle as (select *, sum(n) over (partition by make, origin order by delay)::bigint as known from cells),
grown as (
  select a.make, a.delay, sum(b.known) as later, sum(a.known) filter (where b.known is not null) as now
  from triangle a left join triangle b on b.make = a.make and b.origin = a.origin and b.delay = a.delay + 1 group by all),
growth as (select make, delay, case when now > 0 then later / now::double else 1.0 end as growth from grown),
factors as (
  select make, delay, growth, 1 / product(growth) over (partition by make order by delay rows between current row and unbounded following) as complete
  from growth)"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    lines = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), b.day("l_shipdate").alias("filed"))
    orders = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("make"), b.day("o_orderdate").alias("incident")
    )
    return delay.triangle(lines.join(orders, "k"), "incident", "filed", ["make"], _START, _AS_OF, _DAYS)


@query("filing_triangle", f"with {_TRIANGLE} select make, origin, delay, n, known from triangle")
def filing_triangle(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf)


@query(
    "filing_completion",
    f"""with {_TRIANGLE},
newest as (select make, origin, max(delay) as delay, arg_max(known, delay) as known from triangle group by all)
select make, origin, delay, known, round(growth, 6) as growth, round(complete, 6) as complete, round(known / complete, 4) as expected
from newest join factors using (make, delay)""",
)
def filing_completion(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the newest windows corrected for what is still to be filed."""
    cells = as_table(_cells(spark, sf), "triangle")
    growth = delay.completion(cells, ["make"]).select("make", "delay", F.round("growth", 6).alias("growth"))
    return delay.corrected_counts(cells, ["make"]).join(growth, ["make", "delay"]).select(
        "make", "origin", "delay", "known", "growth", F.round("complete", 6).alias("complete"), F.round("expected", 4).alias("expected")
    )

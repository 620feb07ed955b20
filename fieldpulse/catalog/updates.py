"""Upserts, audited verdicts, states, integrity and feed comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.catalog import bindings as b
from fieldpulse.catalog.registry import query
from fieldpulse.functions.labels import rate_ratio, severity
from fieldpulse.operators import merge
from fieldpulse.plans import agreement as digests
from fieldpulse.plans.profile import feed_agreement
from fieldpulse.runtime import scratch_path
from fieldpulse.schema import TABLES, Table, cascade, conform, violations
from fieldpulse.sources.tables import load_snapshot, save_snapshot
from fieldpulse.streaming.incremental import snapshot_changes

NOW = "2000-02-01 00:00:00"
OLD = "2000-01-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


# --- complaints ------------------------------------------------------------------------


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that are not partly shipped are stored already; open ones came without components."""
    rows = b.reports(spark, sf).filter(F.col("model") != "P")
    return conform(
        rows.withColumn("components", F.when(F.col("model") == "F", F.col("components")))
        .withColumn("source", F.lit("flat"))
        .withColumn("ingested_at", F.lit(OLD).cast("timestamp"))
        .withColumn("is_failure_report", F.col("model") == "F"),
        "complaints",
    )


def _delivered(spark: SparkSession, sf: str) -> DataFrame:
    """A delivery of the unfinished orders: refreshed open ones and new partial ones."""
    rows = b.reports(spark, sf).filter(F.col("model") != "F")
    return rows.select(
        "odi_number", F.lower("make").alias("make"), "model",
        F.col("model_year").cast("smallint").alias("model_year"), "components_coarse",
        F.concat(F.lit("New "), "summary").alias("summary"), "date_of_incident", "date_complaint_filed",
        F.lit(True).alias("crash"),
    )


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        "odi_number", "make", "model", F.array_join("components", "|").alias("components"),
        F.array_join("components_coarse", "|").alias("components_coarse"), "source", "summary",
        "summary_stripped", "crash", "is_failure_report",
        (F.col("ingested_at") == _now()).alias("touched"),
    )


def _upsert_sql(source: str, updated: str, inserted: str) -> str:
    return f"""with {b.SQL_REPORTS}
select odi_number, case when model = 'F' then make else lower(make) end as make, model,
       array_to_string(case model when 'F' then components when 'O' then {updated} else {inserted} end, '|') as components,
       array_to_string(components_coarse, '|') as components_coarse,
       case when model = 'F' then 'flat' else '{source}' end as source,
       case when model = 'F' then summary else 'New ' || summary end as summary,
       case when model <> 'P' then summary_stripped end as summary_stripped,
       case when model <> 'F' then true end as crash,
       case when model <> 'P' then model = 'F' end as is_failure_report, model <> 'F' as touched
from reports"""


@query("upsert_api", _upsert_sql("api", "components_coarse", "null"))
def upsert_api(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(merge.upsert_api(_stored(spark, sf), _delivered(spark, sf), _now()))


@query("upsert_flat", _upsert_sql("flat", "components", "components"))
def upsert_flat(spark: SparkSession, sf: str) -> DataFrame:
    full = b.order_components(spark, sf)
    rows = _delivered(spark, sf).join(full, "odi_number", "left")
    return _shown(merge.upsert_flat(_stored(spark, sf), rows, _now()))


@query(
    "ingest_diff",
    """select case o_orderstatus when 'O' then 'refreshed' else 'inserted' end as arrival, o_orderpriority as make, count(*) as n
from orders where o_orderstatus <> 'F' group by all""",
)
def ingest_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.reports(spark, sf, components=False)
    known, incoming = rows.filter(F.col("model") != "P"), rows.filter(F.col("model") != "F")
    return (
        merge.arrivals(known, incoming, ["odi_number"])
        .groupBy("arrival", "make")
        .agg(F.count("*").alias("n"))
    )


@query(
    "upsert_recalls",
    f"""with {b.SQL_RECALLS}
select campaign_number, make, model, model_year::bigint as model_year,
       case when p_size >= 20 then upper(component) else component end as component, p_size >= 20 as touched
from recalls where p_size <= 30 or p_size >= 20""",
)
def upsert_recalls(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes up to 30 are stored, sizes from 20 on are delivered again with new text."""
    rows = b.recalls(spark, sf)
    stored = conform(
        rows.filter(F.col("p_size") <= 30).drop("p_size", "p_partkey").withColumn("ingested_at", F.lit(OLD)),
        "recalls",
    )
    delivered = rows.filter(F.col("p_size") >= 20).drop("p_size", "p_partkey").withColumn(
        "component", F.upper("component")
    )
    return merge.upsert_recalls(stored, delivered, _now()).select(
        "campaign_number", "make", "model", F.col("model_year").cast("bigint").alias("model_year"),
        "component", (F.col("ingested_at") == _now()).alias("touched"),
    )


@query(
    "upsert_vectors",
    """select vec_id as odi_number, label < 7 as has_raw, label > 3 as has_stripped,
       case when label > 3 then 'second' else 'first' end as model,
       case when label < 7 then round(embedding[1]::double, 5) end as raw_first
from embeddings""",
)
def upsert_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Raw vectors of low labels are stored; stripped vectors of high labels arrive."""
    rows = b.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "odi_number")
    stored = conform(
        rows.filter(F.col("label") < 7).select(
            "odi_number", "embedding", F.lit("first").alias("model"), F.lit(OLD).alias("embedded_at")
        ),
        "complaint_embeddings",
    )
    arriving = rows.filter(F.col("label") > 3).select("odi_number", F.col("embedding").alias("vector"))
    return merge.upsert_vector(stored, arriving, "embedding_stripped", "second", _now()).select(
        "odi_number", F.col("embedding").isNotNull().alias("has_raw"),
        F.col("embedding_stripped").isNotNull().alias("has_stripped"), "model",
        F.round(F.col("embedding")[0].cast("double"), 5).alias("raw_first"),
    )


@query(
    "upsert_recall_vectors",
    f"""with {b.SQL_RECALLS}
select campaign_number, make, model, model_year::bigint as model_year,
       case when p_size >= 20 then 2.0 else 1.0 end::double as first_value,
       case when p_size >= 20 then 'second' else 'first' end as model_name
from recalls where p_size <= 30 or p_size >= 20""",
)
def upsert_recall_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The recall's vector is its constant round number; sizes from 20 on are embedded again."""
    rows = b.recalls(spark, sf)
    keys = list(merge.RECALL_KEY)
    vector = lambda x: F.array(F.lit(x)).cast("array<float>")
    stored = conform(
        rows.filter(F.col("p_size") <= 30).select(
            *keys, vector(1.0).alias("embedding"), F.lit("first").alias("model_name"),
            F.lit(OLD).alias("embedded_at"),
        ),
        "recall_embeddings",
    )
    arriving = rows.filter(F.col("p_size") >= 20).select(*keys, vector(2.0).alias("vector"))
    return merge.upsert_recall_vectors(stored, arriving, "second", _now()).select(
        "campaign_number", "make", "model", F.col("model_year").cast("bigint").alias("model_year"),
        F.col("embedding")[0].cast("double").alias("first_value"), "model_name",
    )


@query(
    "missing_vectors",
    "select doc_id from documents anti join (select doc_id from labels where quality = 1) l using (doc_id)",
)
def missing_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A label of low quality stands for a stored row whose vector is NULL."""
    stored = b.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, F.lit(1.0)).alias("embedding")
    )
    docs = b.table(spark, sf, "documents").select("doc_id")
    return merge.missing_vectors(docs, stored, ["doc_id"], "embedding")


@query(
    "dedupe_last_wins",
    """select user_id, event_id, event_type, value from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""",
)
def dedupe_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return merge.last_wins(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "recall_last_wins",
    f"with {b.SQL_RECALLS} select campaign_number, make, model, model_year::bigint as model_year, summary from recalls",
)
def recall_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return b.recalls(spark, sf).select(
        "campaign_number", "make", "model", F.col("model_year").cast("bigint").alias("model_year"), "summary"
    )


# --- patterns ----------------------------------------------------------------------------


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """A new verdict for every part key; keys without a customer are unknown patterns."""
    return b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") < 10, "novel").when(F.col("p_size") < 30, "known")
        .otherwise("partially_covered").alias("verdict"),
        F.when(F.col("p_size") >= 10, F.col("p_brand")).alias("recall_ref"),
    )


_ANSWERS = f"""{b.SQL_PATTERNS},
answers as (
  select p_partkey as id, case when p_size < 10 then 'novel' when p_size < 30 then 'known'
                               else 'partially_covered' end as verdict,
         case when p_size >= 10 then p_brand end as recall_ref from part)"""


def _written(spark: SparkSession, sf: str):
    return merge.write_verdicts(b.stored_patterns(spark, sf), _answers(spark, sf), "batch", _now())


@query(
    "verdict_next",
    f"""with {_ANSWERS}
select id, case when verdict is null then novelty_verdict else verdict end as novelty_verdict,
       case when verdict is null then novelty_recall_ref else recall_ref end as novelty_recall_ref,
       verdict is not null as touched
from stored left join answers using (id)""",
)
def verdict_next(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, sf)[0].select(
        "id", "novelty_verdict", "novelty_recall_ref", (F.col("updated_at") == _now()).alias("touched")
    )


@query(
    "verdict_history",
    f"""with {_ANSWERS}
select id as pattern_id, novelty_verdict as old_verdict, novelty_recall_ref as old_recall_ref,
       verdict as new_verdict, recall_ref as new_recall_ref, 'batch' as source
from stored join answers using (id)
where novelty_verdict is not null
  and (novelty_verdict <> verdict or novelty_recall_ref is distinct from recall_ref)""",
)
def verdict_history(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, sf)[1].drop("changed_at")


@query(
    "history_appended",
    f"""with {_ANSWERS},
first as (
  select row_number() over (order by id) as hid, id as pattern_id, novelty_verdict as old_verdict,
         novelty_recall_ref as old_recall_ref, verdict as new_verdict, recall_ref as new_recall_ref, 'batch' as source
  from stored join answers using (id)
  where novelty_verdict is not null
    and (novelty_verdict <> verdict or novelty_recall_ref is distinct from recall_ref)),
renewed as (
  select id, case when verdict is null then novelty_verdict else verdict end as v,
         case when verdict is null then novelty_recall_ref else recall_ref end as r
  from stored left join answers using (id))
select hid as id, * exclude (hid) from first
union all
select (select count(*) from first) + row_number() over (order by id), id, v, r, 'novel', null, 'recheck'
from renewed where v is not null and (v <> 'novel' or r is not null)""",
)
def history_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Two audited writes, the second onto what the first left; the history is stored and read between them."""
    root = scratch_path(spark, "audit")
    none_yet = spark.createDataFrame([], TABLES["novelty_history"].schema)
    renewed, first, _ = _written(spark, sf)
    save_snapshot(merge.append_history(none_yet, first), root, "novelty_history", 1)
    recheck = renewed.select("id", F.lit("novel").alias("verdict"), F.lit(None).cast("string").alias("recall_ref"))
    _, second, _ = merge.write_verdicts(renewed, recheck, "recheck", _now())
    stored = load_snapshot(spark, root, "novelty_history")
    save_snapshot(merge.append_history(stored, second), root, "novelty_history", 2)
    return load_snapshot(spark, root, "novelty_history").drop("changed_at")


@query("verdict_unknown", "select p_partkey as id from part anti join customer on c_custkey = p_partkey")
def verdict_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, sf)[2]


_LAST_STATE = """
last as (
  select user_id as id, case event_type when 'purchase' then 'reviewed' when 'error' then 'hidden' else 'new' end as new_state
  from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
  where rn = 1)"""


def _state_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return b.table(spark, sf, "events").select(
        F.col("user_id").alias("id"),
        F.when(kind == "purchase", "reviewed").when(kind == "error", "hidden").otherwise("new").alias("state"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
    )


@query(
    "state_latest",
    f"""with {b.SQL_PATTERNS}, {_LAST_STATE}
select id, coalesce(new_state, state) as state, new_state is not null as touched from stored left join last using (id)""",
)
def state_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = merge.apply_states(b.stored_patterns(spark, sf), _state_events(spark, sf))
    return rows.select("id", "state", (F.col("updated_at") != F.lit(OLD).cast("timestamp")).alias("touched"))


@query(
    "state_changes",
    f"""with {b.SQL_PATTERNS}, {_LAST_STATE}
select id, 'changed' as change from stored join last using (id) where state <> new_state""",
)
def state_changes(spark: SparkSession, sf: str) -> DataFrame:
    before = b.stored_patterns(spark, sf)
    after = merge.apply_states(before, _state_events(spark, sf))
    return snapshot_changes(before, after, "id", ["state"])


@query(
    "apply_scores",
    """with counts as (
  select o_custkey as id, count(*) filter (where o_orderstatus = 'O') as recent_count,
         count(*) filter (where o_orderstatus = 'F') as baseline_count from orders group by 1),
rated as (select *, case when baseline_count > 0
                         then (recent_count / 60.0::double) / (baseline_count / 365.0::double) end as ratio from counts)
select c_custkey as id, recent_count, baseline_count, round(ratio, 6) as ratio,
       case when recent_count is null or ratio is null then null when ratio >= 4 then 'high'
            when ratio >= 2 then 'medium' when ratio >= 1 then 'low' else 'none' end as severity
from customer left join rated on id = c_custkey""",
)
def apply_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores delivered for customers with orders; the other patterns keep their NULLs."""
    counts = b.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("recent_count"),
        F.count_if(F.col("o_orderstatus") == "F").alias("baseline_count"),
    )
    scores = counts.withColumn("ratio", rate_ratio(F.col("recent_count"), F.col("baseline_count"))).withColumn(
        "severity", severity(F.col("ratio"))
    )
    stored = b.stored_patterns(spark, sf).select(
        "id", "name", F.lit(None).cast("bigint").alias("recent_count"),
        F.lit(None).cast("bigint").alias("baseline_count"), F.lit(None).cast("double").alias("ratio"),
        F.lit(None).cast("string").alias("severity"), "updated_at",
    )
    return merge.apply_scores(stored, scores, _now()).select(
        "id", "recent_count", "baseline_count", F.round("ratio", 6).alias("ratio"), "severity"
    )


# --- integrity ---------------------------------------------------------------------------

_RULES = {
    t.name: t
    for t in (
        Table("orders", "o_orderkey bigint, o_custkey bigint", key=("o_orderkey",),
              parents=((("o_custkey",), "supplier", ("s_suppkey",)),)),
        Table("lineitem", "l_orderkey bigint, l_linenumber int", key=("l_orderkey", "l_linenumber"),
              required=("l_shipdate",), unique=(("l_partkey",),),
              parents=((("l_orderkey",), "orders", ("o_orderkey",)),)),
    )
}


@query(
    "integrity_violations",
    """select 'primary_key:l_orderkey,l_linenumber' as rule, l_orderkey || '|' || l_linenumber as key, count(*) as n
from lineitem group by l_orderkey, l_linenumber having count(*) > 1
union all
select 'unique:l_partkey', l_partkey::varchar, count(*) from lineitem group by l_partkey having count(*) > 1
union all
select 'not_null:l_shipdate', l_orderkey || '|' || l_linenumber, count(*) from lineitem
where l_shipdate is null group by l_orderkey, l_linenumber
union all
select 'foreign_key:l_orderkey->orders', l_orderkey::varchar, count(*) from lineitem
anti join orders on o_orderkey = l_orderkey group by l_orderkey
union all
select 'foreign_key:o_custkey->supplier', o_custkey::varchar, count(*) from orders
anti join supplier on s_suppkey = o_custkey group by o_custkey""",
)
def integrity(spark: SparkSession, sf: str) -> DataFrame:
    frames = {n: b.table(spark, sf, n) for n in ("lineitem", "orders", "supplier")}
    return violations("lineitem", frames, _RULES).unionByName(violations("orders", frames, _RULES))


@query(
    "cascade_delete",
    "select vec_id as odi_number, label::bigint as label from embeddings semi join labels on doc_id = vec_id",
)
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors whose labelled parent remains."""
    child = b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("odi_number"), F.col("label").cast("bigint").alias("label")
    )
    return cascade(child, ("odi_number",), b.table(spark, sf, "labels"), ("doc_id",))


@query(
    "feed_agreement",
    """with feed as (
  select l_orderkey as k, max(l_linestatus) as status, min(l_shipdate)::date as d from lineitem group by 1),
both_feeds as (
  select o.o_orderkey, k, o_orderstatus = status as same_status, o_orderdate::date = d as same_day
  from orders o full join feed on k = o_orderkey)
select count(*) as keys, count(*) filter (where k is not null and o_orderkey is not null) as in_both,
       count(*) filter (where k is null) as left_only, count(*) filter (where o_orderkey is null) as right_only,
       round(avg(same_status::int::double) filter (where k is not null and o_orderkey is not null), 6) as status_match,
       round(avg(same_day::int::double) filter (where k is not null and o_orderkey is not null), 6) as d_match
from both_feeds""",
)
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Orders against what their lines say about them."""
    left = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), b.day("o_orderdate").alias("d")
    )
    right = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.max("l_linestatus").alias("status"), F.min(b.day("l_shipdate")).alias("d")
    )
    rows = feed_agreement(left, right, "k", ["status", "d"])
    return rows.withColumns({c: F.round(c, 6) for c in ("status_match", "d_match")})


@query(
    "feed_agreement_digests",
    """with ends as (select max(o_orderdate::date) as last_day, max(o_totalprice) as dearest from orders),
refreshed as (
  select o_orderkey as k, o_orderstatus as status,
         case when o_totalprice = dearest then o_orderdate::date + 1 else o_orderdate::date end as d
  from orders, ends where o_orderdate::date < last_day),
both_feeds as (
  select o.o_orderkey, k, o_orderstatus = status as same_status, o_orderdate::date = d as same_day
  from orders o full join refreshed on k = o_orderkey)
select count(*) as keys, count(*) filter (where k is not null and o_orderkey is not null) as in_both,
       count(*) filter (where k is null) as left_only, count(*) filter (where o_orderkey is null) as right_only,
       round(avg(same_status::int::double) filter (where k is not null and o_orderkey is not null), 9) as status_match,
       round(avg(same_day::int::double) filter (where k is not null and o_orderkey is not null), 9) as d_match
from both_feeds""",
)
def agreement_by_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Orders against an earlier delivery of them, which lacks the last day and dates the dearest order a day later."""
    orders = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), b.day("o_orderdate").alias("d"), "o_totalprice"
    )
    last_day, dearest = orders.agg(F.max("d"), F.max("o_totalprice")).first()
    dated = F.when(F.col("o_totalprice") == F.lit(dearest), F.date_add("d", 1)).otherwise(F.col("d"))
    earlier = orders.filter(F.col("d") < F.lit(last_day)).withColumn("d", dated)
    left, right = (
        digests.store(df, scratch_path(spark, "feed"), "k", ["status", "d"], 64) for df in (orders, earlier)
    )
    return digests.agreement(left, right).withColumns({c: F.round(c, 9) for c in ("status_match", "d_match")})

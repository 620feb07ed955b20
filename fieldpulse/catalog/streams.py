"""Streaming jobs run to completion over what has arrived."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpulse.catalog import bindings as b
from fieldpulse.catalog.registry import query
from fieldpulse.catalog.ingest import LANDED_SQL, responses
from fieldpulse.operators.buckets import BucketTable
from fieldpulse.operators.merge import last_wins, upsert_api
from fieldpulse.operators.normalise import accepted
from fieldpulse.operators.sketches import FIELDS, distinct, shared, sketch_sink
from fieldpulse.runtime import drop_path, scratch_path, short_shuffles
from fieldpulse.schema import TABLES
from fieldpulse.streaming.incremental import (
    counting_sink,
    counts_over_time,
    epoch_sink,
    filed_once,
    hold_back,
    landing_stream,
    lateness,
    latest_epoch,
    release,
    report_stream,
    run_available,
    state_changes,
)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return landing_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _landed_events(spark: SparkSession, sf: str, batch: Column, batches: int = 4) -> DataFrame:
    """The events landed again, a file to a micro-batch, in the order of the number ``batch``."""
    path = scratch_path(spark, "events")
    events = b.table(spark, sf, "events").withColumn("_batch", batch)
    for n in range(batches):
        events.filter(F.col("_batch") == n).drop("_batch").coalesce(1).write.mode("append").parquet(path)
    return landing_stream(spark, path, events.drop("_batch").schema, per_batch=1)


def _windows(spark: SparkSession, sf: str, width: str, slide: str | None) -> DataFrame:
    out, progress = scratch_path(spark, "windows"), scratch_path(spark, "progress")
    rows = counts_over_time(_events(spark, sf), "ts", ["event_type"], width, slide)
    run_available(rows, epoch_sink(out), progress, mode="update")
    schema = rows.schema.add("epoch", T.IntegerType())
    stored = spark.read.schema(schema).parquet(out)
    return latest_epoch(stored, ["window_start", "window_end", "event_type"])


@query(
    "stream_daily_counts",
    """select date_trunc('day', ts)::timestamp as window_start, date_trunc('day', ts)::timestamp + interval 1 day as window_end,
       event_type, count(*) as n from events group by all""",
)
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _zoneless(_windows(spark, sf, "1 day", None))


@query(
    "stream_sliding_counts",
    """with spans as (
  select event_type, time_bucket(interval 12 hour, ts, timestamp '2024-01-01') - k * interval 12 hour as window_start
  from events, (select unnest([0, 1]) as k))
select window_start, window_start + interval 24 hour as window_end, event_type, count(*) as n from spans group by all""",
)
def stream_sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _zoneless(_windows(spark, sf, "24 hours", "12 hours"))


def _zoneless(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


_QUARTER = """least(floor((epoch_us(ts) - low) * 4 / (high - low + 1)), 3)"""
_QUARTERS = f"""
quarters as (
  select e.*, {_QUARTER}::int as quarter
  from events e, (select epoch_us(min(ts)) as low, epoch_us(max(ts)) as high from events))"""


def _quarters(spark: SparkSession, sf: str) -> DataFrame:
    """The events with the quarter of the feed's time that they lie in, 0 to 3."""
    events = b.table(spark, sf, "events")
    low, high = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    place = (F.unix_micros("ts") - F.lit(low or 0)) * 4 / F.lit((high or 0) - (low or 0) + 1)
    return events.withColumn("quarter", F.least(F.floor(place), F.lit(3)).cast("int"))


@query(
    "stream_filed_once",
    f"""with {_QUARTERS} select user_id, min(quarter) as quarter, true as whole_row, count(*) as sightings from quarters group by 1""",
)
def stream_filed_once(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's first event over four micro-batches, within a watermark longer than the feed.

    The sighting that stays is of the first micro-batch with the user; which one of that is the stream's choice.
    """
    out, progress, path = scratch_path(spark, "once"), scratch_path(spark, "progress"), scratch_path(spark, "events")
    feed = _quarters(spark, sf)
    for n in range(4):
        feed.filter(F.col("quarter") == n).coalesce(1).write.mode("append").parquet(path)
    stream = landing_stream(spark, path, feed.schema, per_batch=1)
    run_available(filed_once(stream, "user_id", "ts", "600 days"), epoch_sink(out), progress)
    kept = spark.read.schema(feed.schema).parquet(out)
    own = [F.col(f"k.{c}").eqNullSafe(F.col(c)) for c in feed.columns]
    both = feed.join(kept.select("user_id", F.struct(*feed.columns).alias("k")), "user_id")
    return both.groupBy("user_id").agg(
        F.max("k.quarter").alias("quarter"), F.bool_or(reduce(Column.__and__, own)).alias("whole_row"), F.count("*").alias("sightings")
    )


@query(
    "stream_upsert",
    """select user_id, event_id, event_type, value from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""",
)
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Four micro-batches, in an order of their own, merged into a bucketed table keyed by user."""
    stream = _landed_events(spark, sf, F.pmod(F.xxhash64("event_id"), F.lit(4))).select("user_id", "event_id", "event_type", "value", "ts")
    table = BucketTable(spark, scratch_path(spark, "merged"), stream.schema, ["user_id"], 16)
    newest = lambda current, batch: last_wins(current.unionByName(batch), ["user_id"], ["ts", "event_id"])
    run_available(stream, table.upsert_sink(newest, ["ts", "event_id"]), scratch_path(spark, "progress"))
    return table.read().drop("ts")


# Responses repeat themselves: on the test tables the fastest level makes them a twelfth, for no more CPU time than plain files.
_PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 50_000}


@query(
    "stream_ingest",
    f"""with {LANDED_SQL}
select o_orderkey as odi_number, make, 'NATION ' || nation as model, year(o_orderdate)::bigint as model_year,
       'PRIORITY ' || o_orderpriority || '|STATUS ' || o_orderstatus as components_coarse,
       'PRIORITY ' || o_orderpriority || '|STATUS ' || o_orderstatus as components,
       'Order of ' || c_name as summary, 'api' as source
from records where reject_reason is null""",
)
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Landed responses streamed through normalisation into the complaint table, in order of arrival.

    Every response comes twice, first as a draft; some drafts share a micro-batch with what replaces them. The
    refresh of a stored row without full components fills in the coarse ones.
    """
    path, progress = scratch_path(spark, "landing"), scratch_path(spark, "progress")
    final = responses(spark, sf).withColumn("landed_seq", F.col("key_ord") + F.lit(1 << 40))
    draft = responses(spark, sf).withColumns(
        {"landed_seq": F.col("key_ord"), "body": F.regexp_replace("body", "Order of", "Draft of")}
    )
    late = F.col("key_ord") % 2 == 0
    now = F.lit("2000-02-01 00:00:00").cast("timestamp")
    table = BucketTable(spark, scratch_path(spark, "complaints"), TABLES["complaints"].schema, ["odi_number"], 16)
    sink = table.upsert_sink(lambda current, batch: upsert_api(current, batch, now), ["landed_seq", "rec_ord"], keep=1)
    with short_shuffles(spark):
        for rows in (draft, final.filter(late).unionByName(draft.filter(late)), final.filter(~late)):
            # A delivery is a micro-batch, in as many files as its size asks for. They are compressed, so a task reads a file
            # whole, and go once the stream has recorded that the delivery is merged.
            rows.drop("key_ord").write.mode("append").options(**_PACKED).json(path)
            run_available(accepted(report_stream(spark, path)), sink, progress)
            drop_path(spark, path)
    return table.read().select(
        "odi_number", "make", "model", F.col("model_year").cast("bigint").alias("model_year"),
        F.array_join("components_coarse", "|").alias("components_coarse"),
        F.array_join("components", "|").alias("components"), "summary", "source",
    )


@query(
    "stream_rejects",
    f"""with {LANDED_SQL}
select coalesce(reject_reason, 'accepted') as outcome, count(*) as n, true as kept_all from records group by 1""",
)
def stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Three micro-batches, one delivery each: rejects counted by reason, accepted rows passed on."""
    path, counts, out, progress = (scratch_path(spark, n) for n in ("landing", "rejects", "accepted", "progress"))
    landed, sink = responses(spark, sf), counting_sink(epoch_sink(out), counts)
    for n in range(3):
        # In as many files as its size asks for.
        landed.filter(F.pmod(F.xxhash64("key_ord"), F.lit(3)) == n).drop("key_ord").write.mode("append").json(path)
        run_available(report_stream(spark, path), sink, progress)
    outcome = F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")
    seen = spark.read.parquet(counts).select(outcome, "n", F.lit(0).alias("passed"))
    passed = spark.read.parquet(out).select(F.lit("accepted").alias("outcome"), F.lit(0).alias("n"), F.lit(1).alias("passed"))
    both = seen.unionByName(passed).groupBy("outcome").agg(F.sum("n").alias("n"), F.sum("passed").alias("passed"))
    kept_all = (F.col("outcome") != "accepted") | (F.col("passed") == F.col("n"))
    return both.select("outcome", "n", kept_all.alias("kept_all"))


@query(
    "held_back",
    """select o_orderkey, filed < date '1998-06-01' as first_run
from (select o_orderkey, o_orderdate::date as filed from orders) where filed < date '1998-12-01'""",
)
def held_back(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs half a year apart with a month's holdback; the second releases what the first held."""
    rows = b.table(spark, sf, "orders").select("o_orderkey", b.day("o_orderdate").alias("filed"))
    early, held = release(rows, "filed", F.lit("1998-06-30").cast("date"), 30)
    late, _ = release(held, "filed", F.lit("1998-12-30").cast("date"), 30)
    return early.select("o_orderkey", F.lit(True).alias("first_run")).unionByName(
        late.select("o_orderkey", F.lit(False).alias("first_run"))
    )


@query(
    "stream_changes",
    """select user_id, event_id as seq, case when before is null then 'added' else 'changed' end as change, before as old, event_type as new
from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
where before is distinct from event_type""",
)
def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A user's last event type as a state: what changes it, over four micro-batches in order of time.

    The third micro-batch is delivered once more with the fourth, which changes nothing.
    """
    out, path = scratch_path(spark, "changes"), scratch_path(spark, "events")
    events = _quarters(spark, sf)
    for quarters in ([0], [1], [2], [2, 3]):
        events.filter(F.col("quarter").isin(quarters)).coalesce(1).write.mode("append").parquet(path)
    stream = landing_stream(spark, path, events.schema, per_batch=1)
    changes = state_changes(stream, "user_id", ["event_type"], "ts", "event_id")
    run_available(changes, epoch_sink(out), scratch_path(spark, "progress"))
    kind = lambda c: F.get_json_object(c, "$.event_type").alias(c)
    return spark.read.schema(changes.schema).parquet(out).select("user_id", "seq", "change", kind("old"), kind("new"))


@query(
    "stream_distinct_users",
    """with seen as (select distinct event_type, ts::date as day, user_id from events),
sizes as (select event_type, ts::date as day, count(*) as events, count(distinct user_id) as users from events group by all)
select event_type, day, events, users,
       (select count(*) from seen a join seen b using (event_type, user_id)
        where a.event_type = s.event_type and a.day = s.day and b.day = s.day - 1) as returning_users
from sizes s""",
)
def stream_distinct_users(spark: SparkSession, sf: str) -> DataFrame:
    """Users of an event type and day, and those seen the day before, from sketches merged over four micro-batches."""
    stream = _landed_events(spark, sf, F.pmod(F.xxhash64("event_id"), F.lit(4)))
    rows = stream.select("event_type", F.to_date("ts").alias("day"), "user_id")
    schema = T.StructType.fromDDL(f"event_type string, day date, {FIELDS}")
    keys = ["event_type", "day"]
    table = BucketTable(spark, scratch_path(spark, "sketches"), schema, keys, 8)
    run_available(rows, sketch_sink(table, keys, "user_id", 18), scratch_path(spark, "progress"))
    now = table.read()
    before = now.select("event_type", F.date_add("day", 1).alias("day"), F.col("seen").alias("seen_before"))
    return now.join(before, keys, "left").select(
        *keys, F.col("n").alias("events"), distinct().alias("users"), shared("seen", "seen_before").alias("returning_users")
    )


_RUNS = (dt.date(1996, 1, 1), dt.date(1997, 6, 30))


@query(
    "stream_held_back",
    f"""with filed as (select o_orderkey, o_orderdate::date as d from orders),
runs as (
  select unnest([1, 2, 3]) as run,
         unnest([(select max(d) from filed where d < date '{_RUNS[0]}'), (select max(d) from filed where d < date '{_RUNS[1]}'),
                 (select max(d) from filed)]) as mark)
select o_orderkey, d as filed, min(run)::int as run, false as late
from filed, runs where d + 31 < mark group by all
union all select -1, date '1992-02-01', 3, true""",
)
def stream_held_back(spark: SparkSession, sf: str) -> DataFrame:
    """Filings of three runs of a stream, each picking up where the last one ended, with thirty days of holdback.

    A filing leaves in the run whose watermark passes its release; one row of the last run comes years too late.
    """
    path, progress, schema = scratch_path(spark, "filings"), scratch_path(spark, "progress"), "o_orderkey bigint, filed date"
    filings = b.table(spark, sf, "orders").select("o_orderkey", b.day("o_orderdate").alias("filed"))
    before = [F.col("filed") < F.lit(d) for d in _RUNS]
    late = spark.range(1).select(F.lit(-1).cast("bigint").alias("o_orderkey"), F.lit("1992-02-01").cast("date").alias("filed"))
    found = []
    for run, rows in enumerate((filings.filter(before[0]), filings.filter(~before[0] & before[1]), filings.filter(~before[1]).union(late)), 1):
        rows.coalesce(1).write.mode("append").parquet(path)
        out = scratch_path(spark, "released")
        stream = landing_stream(spark, path, schema)
        released = hold_back(stream, "o_orderkey", "filed", 30)
        run_available(released, epoch_sink(out), progress)
        found.append(spark.read.schema(released.schema).parquet(out).select("o_orderkey", "filed", F.lit(run).alias("run"), "late"))
    return reduce(DataFrame.unionByName, found)


@query(
    "filing_lateness",
    """select o_orderpriority as make, count(*) as reports, count(*) filter (where lag > 60) as late, max(lag)::bigint as max_lag_days
from (select o_orderpriority, date_diff('day', o_orderdate::date, l_shipdate::date) as lag
      from lineitem join orders on o_orderkey = l_orderkey) group by 1""",
)
def filing_lateness(spark: SparkSession, sf: str) -> DataFrame:
    lines = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), b.day("l_shipdate").alias("filed"))
    orders = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("make"), b.day("o_orderdate").alias("incident")
    )
    rows = lateness(lines.join(orders, "k"), "incident", "filed", 60, "make")
    return rows.withColumn("max_lag_days", F.col("max_lag_days").cast("bigint"))

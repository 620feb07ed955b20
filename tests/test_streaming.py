import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldpulse.operators.buckets import BucketTable
from fieldpulse.operators.merge import last_wins, upsert
from fieldpulse.runtime import scratch_path
from fieldpulse.streaming.incremental import (
    counting_sink,
    counts_over_time,
    epoch_sink,
    filed_once,
    hold_back,
    landing_stream,
    late_rows,
    lateness,
    latest_epoch,
    run_available,
    state_changes,
)

SCHEMA = "k bigint, v string, at timestamp, seq bigint"


def landed(spark, path, batches):
    for n, rows in enumerate(batches):
        data = [(k, v, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), s) for k, v, h, s in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return landing_stream(spark, path, SCHEMA, per_batch=1)


BATCHES = [[(1, "a", 0, 1), (2, "b", 1, 2)], [(1, "c", 30, 3), (3, "d", 31, 4)], [(2, "e", 2, 5), (1, "f", 30, 6)]]


def test_counts_equal_batch(spark, tmp_path):
    path, out = str(tmp_path / "in"), scratch_path(spark, "out")
    stream = landed(spark, path, BATCHES)
    rows = counts_over_time(stream, "at", ["v"], "1 day", delay="10 days")
    run_available(rows, epoch_sink(out), scratch_path(spark, "cp"), mode="update")
    got = latest_epoch(spark.read.parquet(out), ["window_start", "window_end", "v"])
    want = counts_over_time(spark.read.schema(SCHEMA).parquet(path), "at", ["v"], "1 day")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_merge_equals_batch_and_resumes(spark, tmp_path):
    path, cp = str(tmp_path / "in"), scratch_path(spark, "cp")
    table = BucketTable(spark, str(tmp_path / "state"), spark.createDataFrame([], SCHEMA).schema, ["k"], 4)
    applied = []

    def merge(before, batch):
        applied.append(1)
        return upsert(before, batch, ["k"])

    sink = table.upsert_sink(merge, ["at", "seq"])
    state = lambda: {r["k"]: r["v"] for r in table.read().collect()}
    run_available(landed(spark, path, BATCHES[:2]), sink, cp)
    assert state() == {1: "c", 2: "b", 3: "d"} and len(applied) == 2
    run_available(landed(spark, path, BATCHES[2:]), sink, cp)
    assert len(applied) == 3
    want = last_wins(spark.read.schema(SCHEMA).parquet(path), ["k"], ["at", "seq"])
    done = state()
    assert done == {r["k"]: r["v"] for r in want.collect()}
    # A batch replayed after a lost acknowledgement is not even applied.
    replay = spark.createDataFrame([(2, "other", dt.datetime(2024, 1, 1, 2), 5)], SCHEMA)
    files = sorted(table.read().inputFiles())
    sink(replay, 2)
    assert state() == done and len(applied) == 3 and sorted(table.read().inputFiles()) == files


def test_a_merge_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    schema = "k bigint, v string"
    table = BucketTable(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, ["k"], 32)
    assert table.read().count() == 0 and table.version() is None and table.manifest() == {}
    put = lambda before, batch: upsert(before, batch, ["k"])
    table.merge(spark.range(400).selectExpr("id as k", "'a' as v"), put)
    before = {f.rsplit("/", 2)[1]: f for f in table.read().inputFiles()}
    rows = spark.createDataFrame([(7, "b"), (8, "b"), (1_000, "new")], schema)
    touched = table.merge(rows, put)
    after = {f.rsplit("/", 2)[1]: f for f in table.read().inputFiles()}
    assert 1 <= len(touched) <= 3 and len(before) == 32
    assert {name for name in before if before[name] != after[name]} == {f"bucket={b}" for b in touched}
    assert table.read().filter("v = 'b'").count() == 2 and table.read().count() == 401
    # Old versions stay readable until they are dropped; an empty bucket leaves the manifest.
    assert table.read(0).count() == 400
    assert table.read_keys(rows).count() == 3 and len(table.read_keys(rows).inputFiles()) <= 3
    table.merge(rows, lambda current, batch: current.filter("false"))
    assert set(table.manifest()) == set(range(32)) - set(touched)
    assert table.drop_unused() == 2 * len(touched) and table.read().count() == 401 - table_rows(spark, touched)
    assert table.merge(rows.filter("false"), put) == [] and table.version() == 3
    assert table.merge(rows, put, version=3) == [] and table.version() == 3


def table_rows(spark, touched):
    ids = spark.range(400).union(spark.range(1_000, 1_001))
    return ids.filter(F.pmod(F.xxhash64("id"), F.lit(32)).isin(touched)).count()


def test_a_half_written_merge_is_not_seen_and_a_stray_row_is_refused(spark, tmp_path):
    schema = "k bigint, v string"
    table = BucketTable(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, ["k"], 8)
    put = lambda before, batch: upsert(before, batch, ["k"])
    table.merge(spark.range(50).selectExpr("id as k", "'a' as v"), put)
    spark.range(3).selectExpr("id as k", "'lost' as v", "0 as bucket").write.partitionBy("bucket").parquet(f"{table.root}/data/version=1")
    assert table.read().filter("v = 'lost'").isEmpty() and table.version() == 0
    one = spark.createDataFrame([(1, "b")], schema)
    with pytest.raises(Exception, match="did not touch"):
        table.merge(one, lambda current, batch: spark.range(50).selectExpr("id as k", "'c' as v"))
    assert table.version() == 0 and table.read().filter("v = 'a'").count() == 50
    table.merge(one, put)
    assert table.read().filter("v = 'b'").count() == 1 and table.read().count() == 50


def test_first_filing_only(spark, tmp_path):
    path, out = str(tmp_path / "in"), scratch_path(spark, "out")
    run_available(filed_once(landed(spark, path, BATCHES), "k", "at", "30 days"), epoch_sink(out), scratch_path(spark, "cp"))
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_lateness(spark):
    d = dt.date
    df = spark.createDataFrame([("a", d(2024, 1, 1), d(2024, 1, 31)), ("a", d(2024, 1, 1), d(2024, 2, 1)), ("b", None, d(2024, 1, 1))], "g string, i date, f date")
    got = {r["g"]: (r["reports"], r["late"], r["max_lag_days"]) for r in lateness(df, "i", "f", 30, "g").collect()}
    assert got == {"a": (2, 1, 31), "b": (1, 0, None)}


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    late = [*BATCHES[:2], [(9, "late", -400, 7), (9, "late", -500, 8), (9, "in time", 40, 9)]]
    rows = counts_over_time(landed(spark, str(tmp_path / "in"), late), "at", ["v"], "1 day", delay="1 day")
    run = run_available(rows, epoch_sink(scratch_path(spark, "out")), scratch_path(spark, "cp"), mode="update")
    assert late_rows(run) == 2


def test_rejects_are_counted_and_a_replay_does_not_count_twice(spark, tmp_path):
    counts, out = str(tmp_path / "counts"), str(tmp_path / "out")
    sink = counting_sink(epoch_sink(out), counts)
    batch = spark.createDataFrame([(1, None), (2, "bad"), (3, "bad"), (4, "worse")], "k bigint, reject_reason string")
    for epoch in (0, 1, 1):
        sink(batch, epoch)
    got = {r["reject_reason"]: r["n"] for r in spark.read.parquet(counts).groupBy("reject_reason").agg(F.sum("n").alias("n")).collect()}
    assert got == {None: 2, "bad": 4, "worse": 2}
    kept = spark.read.parquet(out)
    assert sorted((r["k"], r["epoch"]) for r in kept.collect()) == [(1, 0), (1, 1)] and "reject_reason" not in kept.columns


def test_changes_are_told_once_and_in_order(spark, tmp_path):
    """Sightings out of order, repeats, a removal and a return, over micro-batches, a restart and a second delivery."""
    path, out, cp = str(tmp_path / "in"), scratch_path(spark, "out"), scratch_path(spark, "cp")
    batches = [[(1, "a", 0, 1), (2, "x", 0, 2), (1, "b", 2, 4), (1, "a", 1, 3)], [(1, "b", 3, 5), (2, "gone", 4, 6), (2, "gone", 5, 7)]]
    later = [[(1, "b", 2, 4), (1, "c", 1, 2), (2, "x", 6, 8)], [(1, "a", 9, 9), (2, None, 9, 10)]]
    for rows in (batches, later, []):
        stream = landed(spark, path, rows).withColumn("away", F.col("v") == "gone")
        changes = state_changes(stream, "k", ["v"], "at", "seq", "away")
        run_available(changes, epoch_sink(out), cp)
    schema = changes.schema
    value = lambda c: F.get_json_object(c, "$.v")
    got = spark.read.schema(schema).parquet(out).select("k", "seq", "change", value("old"), value("new"))
    assert sorted(map(tuple, got.collect())) == [
        (1, 1, "added", None, "a"), (1, 4, "changed", "a", "b"), (1, 9, "changed", "b", "a"),
        (2, 2, "added", None, "x"), (2, 6, "removed", "x", None), (2, 8, "added", None, "x"), (2, 10, "changed", "x", None),
    ]


def test_holdback_releases_each_row_once_over_restarts(spark, tmp_path):
    path, cp, schema = str(tmp_path / "in"), scratch_path(spark, "cp"), "k bigint, filed date"
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    runs = [
        [(1, day(0)), (2, day(0)), (3, day(3)), (4, None)],
        [(5, day(9)), (6, day(2)), (6, day(2))],
        [(7, day(1)), (8, day(40))],
        [],
    ]
    seen = []
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        out = scratch_path(spark, "out")
        released = hold_back(landing_stream(spark, path, schema), "k", "filed", 5, shards=2)
        run_available(released, epoch_sink(out), cp)
        seen.append(sorted((r["k"], r["late"]) for r in spark.read.schema(released.schema).parquet(out).collect()))
    # Day 9 passes the release of days 0 to 2 and not of day 3; day 40 that of all before; 7 came after its release.
    assert seen == [[(4, False)], [(1, False), (2, False), (6, False), (6, False)], [(3, False), (5, False), (7, True)], []]


def test_a_large_bucket_is_several_files(spark, tmp_path):
    schema = spark.createDataFrame([], "k bigint, v string").schema
    table = BucketTable(spark, str(tmp_path / "large"), schema, ["k"], 1)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        table.merge(spark.range(0, 8_000, 1, 4).selectExpr("id as k", "sha2(string(id), 256) as v"), lambda current, new: current.unionByName(new))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert table.read().count() == 8_000 and len(table.read().inputFiles()) > 1


def test_landed_deliveries_come_in_as_many_files_as_tasks(spark, tmp_path):
    import glob

    import __spark_entry__ as entry

    spark.sql(
        "select id as o_orderkey, id % 20 as o_custkey, substr('OFP', int(id % 3) + 1, 1) as o_orderstatus, "
        "if(id % 2 = 0, '2-HIGH', '5-LOW') as o_orderpriority, timestamp_ntz '1995-01-01' as o_orderdate from range(300)"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select id as c_custkey, 'c' as c_name, 'M' as c_mktsegment, int(id % 3) + 4 as c_nationkey from range(20)").write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    below = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/**/landing-*/*.json".removeprefix("file:")
    before = set(glob.glob(below, recursive=True))
    outcomes = entry.queries()["stream_rejects"](spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in outcomes) > 0 and all(r["kept_all"] for r in outcomes)
    assert len(set(glob.glob(below, recursive=True)) - before) > 3


def test_arrivals_of_a_merge_go_with_it_whether_it_succeeds_or_fails(spark, tmp_path):
    import glob

    schema = "k bigint, v string"
    below = f"{scratch_path(spark, 'none').rsplit('/', 1)[0]}/arrivals-*".removeprefix("file:")
    before = set(glob.glob(below))
    table = BucketTable(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, ["k"], 8)
    table.merge(spark.range(50).selectExpr("id as k", "'a' as v"), lambda current, new: upsert(current, new, ["k"]))
    with pytest.raises(Exception, match="did not touch"):
        table.merge(spark.createDataFrame([(1, "b")], schema), lambda current, new: spark.range(50).selectExpr("id as k", "'c' as v"))
    assert set(glob.glob(below)) == before and table.read().count() == 50


def test_a_sink_keeps_as_many_versions_as_asked(spark, tmp_path):
    path, cp = str(tmp_path / "in"), scratch_path(spark, "cp")
    table = BucketTable(spark, str(tmp_path / "state"), spark.createDataFrame([], SCHEMA).schema, ["k"], 4)
    put = lambda before, batch: upsert(before, batch, ["k"])
    sink = table.upsert_sink(put, ["at", "seq"], keep=1)
    run_available(landed(spark, path, BATCHES), sink, cp)
    want = last_wins(spark.read.schema(SCHEMA).parquet(path), ["k"], ["at", "seq"])
    state = lambda: {r["k"]: r["v"] for r in table.read().collect()}
    assert state() == {r["k"]: r["v"] for r in want.collect()}
    folders = lambda: sorted(p.parent.name + "/" + p.name for p in (tmp_path / "state/data").glob("*/bucket=*"))
    assert folders() == sorted(f"version={v}/bucket={b}" for b, v in table.manifest().items())
    assert [p.name for p in (tmp_path / "state/manifest").glob("version=*")] == [f"version={table.version()}"]
    # A replayed micro-batch still finds its merge published.
    sink(spark.createDataFrame([(2, "other", dt.datetime(2024, 1, 1, 2), 5)], SCHEMA), 2)
    assert state() == {r["k"]: r["v"] for r in want.collect()}


def test_shuffle_files_go_as_an_execution_ends(spark):
    import time

    from fieldpulse.runtime import _SHUFFLES_GO, short_shuffles

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found, every = set(), disk.getAllFiles()
        for n in range(every.size()):
            name = every.apply(n).getName()
            found |= {name} if name.startswith("shuffle_") else set()
        return found

    before, setting = files(), spark.conf.get(_SHUFFLES_GO, None)
    with short_shuffles(spark):
        inside = spark.range(1_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("g")).count()
        assert inside.collect() and spark.conf.get(_SHUFFLES_GO) == "true"
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(_SHUFFLES_GO, None) == setting
    # A second execution shuffles again.
    assert sum(r["count"] for r in inside.collect()) == 1_000
    outside = spark.range(1_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("g")).count()
    kept = files()
    assert outside.collect() and files() - kept


def test_ingest_keeps_one_packed_delivery_and_one_version(spark, tmp_path, monkeypatch):
    import glob

    import __spark_entry__ as entry
    from fieldpulse.catalog import streams

    spark.sql(
        "select id as o_orderkey, id % 20 as o_custkey, substr('OFP', int(id % 3) + 1, 1) as o_orderstatus, "
        "if(id % 2 = 0, '2-HIGH', '3-MEDIUM') as o_orderpriority, timestamp_ntz '1995-01-01' as o_orderdate from range(300)"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select id as c_custkey, concat('c', id) as c_name, 'M' as c_mktsegment, int(id % 6) as c_nationkey from range(20)").write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    root = scratch_path(spark, "none").rsplit("/", 1)[0].removeprefix("file:")
    names = lambda what: set(glob.glob(f"{root}/{what}"))
    before = {what: names(what) for what in ("landing-*", "arrivals-*", "complaints-*")}
    files_before, deliveries = names("landing-*/*.json*"), []

    def run(stream, sink, checkpoint):
        files = names("landing-*/*.json*") - files_before
        rows = spark.read.json(sorted(files))
        deliveries.append((all(f.endswith(".json.gz") for f in files), rows.count(), rows.filter("body like '%Draft of%'").count()))
        return run_available(stream, sink, checkpoint)

    monkeypatch.setattr(streams, "run_available", run)
    got = {r["odi_number"]: r.asDict() for r in entry.queries()["stream_ingest"](spark, str(tmp_path)).collect()}
    # Nations 0 to 3 are failures, medium open orders lack a summary, high part-filled ones an incident date.
    nation = lambda k: k % 20 % 6
    good = [k for k in range(300) if nation(k) > 3 and not (k % 3 == 0 and k % 2) and not (k % 3 == 2 and k % 2 == 0)]
    assert sorted(got) == good and good
    assert all(r["summary"] == f"Order of c{k % 20}" and r["model"] == f"NATION {nation(k)}" for k, r in got.items())
    assert all(r["components"] == r["components_coarse"] for r in got.values())
    # Every delivery was landed whole, and alone.
    assert [n for _, n, _ in deliveries] == [300, 300, 150] and all(packed for packed, _, _ in deliveries)
    drafts = [n for _, _, n in deliveries]
    assert drafts[0] > drafts[1] > 0 and drafts[2] == 0
    assert names("landing-*") == before["landing-*"] and names("arrivals-*") == before["arrivals-*"]
    (table,) = names("complaints-*") - before["complaints-*"]
    assert len(glob.glob(f"{table}/data/*/bucket=*")) == len({f.rsplit("/", 1)[1] for f in glob.glob(f"{table}/data/*/bucket=*")})
    assert len(glob.glob(f"{table}/manifest/version=*")) == 1

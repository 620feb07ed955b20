"""Feeds compared by digests against the full join, and sketches against exact counts."""

import pytest
from pyspark.sql import functions as F

from fieldpulse.operators.buckets import BucketTable
from fieldpulse.operators.sketches import FIELDS, distinct, merged, shared, sketch_sink, sketched
from fieldpulse.plans.agreement import agreement, settled_and_open, store
from fieldpulse.plans.profile import feed_agreement
from fieldpulse.runtime import scratch_path

COLUMNS = ["a", "b"]


def feed(spark, rows):
    return spark.createDataFrame(rows, "k bigint, a string, b string, other int")


def kept(spark, df, buckets=16):
    return store(df, scratch_path(spark, "feed"), "k", COLUMNS, buckets)


ROWS = [(n, f"a{n}", None if n % 5 == 0 else "b", n) for n in range(300)]
CHANGES = {
    "same": ROWS,
    "other order": ROWS[::-1],
    "one value": [(7, "else", "b", 7) if r[0] == 7 else r for r in ROWS],
    "null moved": [(5, None, "a5", 5) if r[0] == 5 else r for r in ROWS],
    "row gone": ROWS[1:],
    "row more": [*ROWS, (1_000, "x", "y", 0)],
    "repeated": [*ROWS, (7, "a7", "b", 7)],
    "hot key": ROWS + [(7, "a7", "b", 7)] * 40,
    "keyless": [*ROWS, (None, "x", "y", 0)],
    "nothing": [],
}


@pytest.mark.parametrize("case", CHANGES)
@pytest.mark.parametrize("turned", [False, True])
def test_digests_give_what_the_full_join_gives(spark, case, turned):
    sides = [feed(spark, ROWS), feed(spark, CHANGES[case])]
    left, right = sides[::-1] if turned else sides
    want = feed_agreement(left, right, "k", COLUMNS)
    got = agreement(kept(spark, left), kept(spark, right))
    assert got.columns == want.columns and got.collect() == want.collect()


def test_rows_of_a_repeat_in_both_feeds_and_of_two_empty_feeds(spark):
    twice = feed(spark, CHANGES["repeated"] + [(None, "x", "y", 0)])
    assert agreement(kept(spark, twice), kept(spark, twice)).collect() == feed_agreement(twice, twice, "k", COLUMNS).collect()
    empty = feed(spark, [])
    assert agreement(kept(spark, empty), kept(spark, empty)).collect() == feed_agreement(empty, empty, "k", COLUMNS).collect()


def test_only_differing_buckets_are_read(spark):
    left, right = kept(spark, feed(spark, ROWS)), kept(spark, feed(spark, CHANGES["one value"]))
    settled, differing = settled_and_open(left, right)
    changed = left.rows().filter("k = 7").first()["bucket"]
    assert differing == [changed] and settled == 300 - left.rows([changed]).count()
    plan = agreement(left, right)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 2 and f"= {changed})" in plan
    assert settled_and_open(left, kept(spark, feed(spark, CHANGES["other order"]))) == (300, [])
    with pytest.raises(ValueError):
        settled_and_open(left, kept(spark, feed(spark, ROWS), 8))


def values(spark, n):
    """A group with three quarters of the rows; every value occurs twice."""
    rows = spark.range(2 * n).select((F.col("id") % n).alias("v"), F.when(F.col("id") % 4 < 3, "hot").otherwise("cold").alias("g"))
    return rows.withColumn("v", F.when(F.col("v") % 10 != 0, F.col("v")))


def test_merged_batches_equal_one_pass_whatever_is_replayed(spark):
    rows = values(spark, 4_000)
    table = BucketTable(spark, scratch_path(spark, "sketches"), spark.createDataFrame([], f"g string, {FIELDS}").schema, ["g"], 4)
    sink = sketch_sink(table, ["g"], "v", 12)
    for epoch in (0, 1, 1, 2, 0):
        sink(rows.filter(F.pmod(F.hash("v", "g"), F.lit(3)) == epoch), epoch)
    state = table.read().select("g", "n", distinct().alias("d"))
    once = sketched(rows, ["g"], "v", 12).select("g", "n", distinct().alias("d"))
    assert sorted(state.collect()) == sorted(once.collect())
    assert {r["g"]: r["n"] for r in state.collect()} == {"hot": 6_000, "cold": 2_000}


def test_exact_up_to_the_size_of_a_sketch_and_close_beyond(spark):
    for n, lg_k in ((1_000, 12), (60_000, 12)):
        rows = values(spark, n)
        exact = {r["g"]: r["d"] for r in rows.groupBy("g").agg(F.countDistinct("v").alias("d")).collect()}
        found = {r["g"]: r["d"] for r in sketched(rows, ["g"], "v", lg_k).select("g", distinct().alias("d")).collect()}
        error = max(abs(found[g] / exact[g] - 1) for g in exact)
        assert error == 0 if n == 1_000 else error < 4 / 2 ** (lg_k / 2)
    total = merged(sketched(values(spark, 1_000), ["g"], "v", 12), [], 12).select("n", distinct().alias("d")).first()
    assert tuple(total) == (2_000, 900)


def test_shared_values_and_missing_sketches(spark):
    rows = spark.createDataFrame([("x", v) for v in range(50)] + [("y", v) for v in range(30, 70)] + [("z", None)], "g string, v int")
    by = sketched(rows, ["g"], "v").groupBy().pivot("g", ["x", "y", "z", "w"]).agg(F.first("seen"))
    found = by.select(shared("x", "y").alias("xy"), shared("x", "z").alias("xz"), shared("x", "w").alias("xw"), distinct("z").alias("z")).first()
    assert tuple(found) == (20, 0, 0, 0)
    assert sketched(rows.limit(0), ["g"], "v").count() == 0


def test_digests_are_of_the_rows_that_were_written(spark):
    """The feed's rows are made once: a second making of them may differ, and costs the whole feed again."""
    made = spark.sparkContext.accumulator(0)

    def mark(x):
        made.add(1)
        return x

    rows = feed(spark, ROWS).withColumn("a", F.udf(mark, "string")("a"))
    assert kept(spark, rows).digests().agg(F.sum("keys")).first()[0] == len(ROWS)
    assert made.value == len(ROWS)

"""Plans and helpers that matter at scale."""

import datetime as dt

from pyspark.sql import functions as F

from fieldpulse.operators.merge import last_wins, upsert_api
from fieldpulse.operators.neighbours import group_copies, neighbours, pool
from fieldpulse.plans.inbox import sample_narratives
from fieldpulse.plans.novelty import pattern_vehicles
from fieldpulse.plans.scoring import score_patterns
from fieldpulse.runtime import checkpoint_dir, cut, scratch_path, spread
from fieldpulse.schema import conform


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, df, name):
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def tables(spark):
    reports = conform(
        spark.range(200).select(
            F.col("id").alias("odi_number"), F.lit("T").alias("make"), F.lit("A").alias("model"),
            F.date_sub(F.lit(dt.date(2024, 6, 30)), F.col("id").cast("int")).alias("date_of_incident"),
            F.lit("s").alias("summary"),
        ),
        "complaints",
    )
    members = spark.range(200).select(
        F.when(F.col("id") < 150, 1).otherwise(F.col("id")).alias("pattern_id"),
        F.col("id").alias("odi_number"), F.rand(1).alias("similarity"),
    )
    return stored(spark, reports, "reports"), stored(spark, members, "members")


def test_scoring_reads_two_columns_and_pushes_the_dates(spark):
    reports, members = tables(spark)
    spark.conf.set("spark.sql.maxMetadataStringLength", "500")
    text = plan(score_patterns(members.select(F.col("pattern_id").alias("id")).distinct(), members, reports, dt.date(2024, 6, 30)))
    assert "ReadSchema: struct<odi_number:bigint,date_of_incident:date>" in text
    assert "GreaterThanOrEqual(date_of_incident,2023-05-02)" in text
    assert "LessThanOrEqual(date_of_incident,2024-06-30)" in text


def test_top_rows_are_limited_before_the_shuffle(spark):
    reports, members = tables(spark)
    text = plan(sample_narratives(members, reports))
    partial = text.index("Partial")
    assert text.index("Final") < text.index("Exchange hashpartitioning(pattern_id") < partial
    assert "ReadSchema: struct<odi_number:bigint,summary:string,summary_stripped:string>" in text


def test_last_wins_is_limited_before_the_shuffle_and_aggregates_no_rows(spark):
    _, members = tables(spark)
    text = plan(last_wins(members, ["pattern_id"], ["similarity", "odi_number"]))
    assert "SortAggregate" not in text
    assert text.index("Final") < text.index("Exchange hashpartitioning(pattern_id") < text.index("Partial")


def test_merge_and_vehicles_use_equi_joins(spark):
    reports, members = tables(spark)
    incoming = reports.select("odi_number", "summary", "components_coarse")
    for df in (upsert_api(reports, incoming, F.current_timestamp()), pattern_vehicles(members, reports)):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_hot_vector_keeps_only_listed_ids(spark):
    rows = [(n, [1.0, 0.0] if n < 300 else [0.0, float(n)]) for n in range(330)]
    units = pool(spark.createDataFrame(rows, "k bigint, e array<double>"), "k", "e")
    groups = group_copies(units, 6)
    assert (groups.rows, groups.heads, groups.groups) == (330, 12, 2)
    assert groups.table.agg(F.max(F.size("ids"))).first()[0] == 6
    got = {r["i"]: r["js"] for r in neighbours(units, 0.9, 5).groupBy("i").agg(F.array_sort(F.collect_list("j")).alias("js")).collect()}
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[299] == [0, 1, 2, 3, 4]
    assert got[329] == [300, 301, 302, 303, 304] and len(got) == 330


def test_checkpoints_go_to_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert configured in checkpoint_dir(spark) and configured in scratch_path(spark, "x")
    df = cut(spark.range(10).withColumn("x", F.rand()))
    assert df.collect() == df.collect()
    assert "Range" not in plan(df)


def test_spread_leaves_split_scans_alone(spark):
    wide = spark.range(100, numPartitions=64)
    assert spread(wide, "id") is wide
    assert spread(spark.range(100, numPartitions=1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism

"""Registered queries on the smallest shared tables: SQL where there is any, and the pipeline."""

from pathlib import Path

import corpus_pipeline
import duckdb
import pytest
from llm_fixtures import awkward, no_rows
from pyspark.sql import functions as F

from fieldpulse.llm import decontaminate, exact, quality, simhash
from fieldpulse.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="shared tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str([row[columns.index(c)] for c in sorted(columns)]) for row in result.fetchall())
    assert sorted(str([r[c] for c in sorted(columns)]) for r in df.collect()) == want


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_take_effect_on_all_that_came_before(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns, counts = docs.columns, [docs.count()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        counts.append(docs.count())
        if n < 4:
            assert docs.columns == columns and docs.exceptAll(before).isEmpty()
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4]
    kept = spark.read.parquet(str(tmp_path / "3"))
    assert exact.exact_duplicates(kept).filter("not kept").isEmpty()
    assert simhash.near_duplicates(kept).groupBy("component_id").count().filter("count > 1").isEmpty()
    assert decontaminate.contamination(kept, benchmark).filter("contaminated").isEmpty()
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in kept.collect()}
    bad = quality.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert bad.filter("predicted = 0").join(kept, "doc_id").isEmpty()


def test_every_stage_takes_awkward_and_empty_tables(spark, tmp_path):
    rows, df = awkward(spark)
    for case, docs in (("rows", df), ("none", no_rows(df))):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if n < 4:
                assert out.columns == docs.columns
            out.withColumns({c: F.col(c).cast("string") for c, t in out.dtypes if t == "void"}).write.parquet(str(tmp_path / case / str(n)))
            docs = spark.read.parquet(str(tmp_path / case / str(n)))

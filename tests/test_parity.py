"""Every registered query against its SQL counterpart on the smallest shared tables."""

from pathlib import Path

import duckdb
import pytest

from fieldpulse.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="shared tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def cell(value):
    return round(value, 9) if isinstance(value, float) else value


def table(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(([cell(row[i]) for i in order] for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, duck, name):
    entry = REGISTRY[name]
    df = entry.run(spark, SF)
    got = table(df.columns, df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert entry.sql is not None
    result = duck.execute(entry.sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == table(columns, result.fetchall())

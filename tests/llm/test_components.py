from fieldpulse.llm.components import components


def test_chains_stars_and_nothing(spark):
    chain = [(n, n + 1) for n in range(50)]
    star = [(1000, n) for n in range(1001, 1100)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a bigint, b bigint")).collect()}
    assert {found[n] for n in range(51)} == {0} and {found[n] for n in range(1000, 1100)} == {1000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0

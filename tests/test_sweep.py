"""Threshold sweeps: what moves follows the rows, counts are those of brute force, scopes come from the rows asked for."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fieldpulse.catalog import bindings
from fieldpulse.operators import neighbours as neighbour_ops
from fieldpulse.operators.cells import bounds_prune
from fieldpulse.operators.neighbours import Grid, pool, threshold_counts
from test_cells import based, clustered

LEVELS = (0.1, 0.4, 1.0)


def rows_of(spark, n, dim=8, seed=0):
    """Random vectors, some ids and some vectors more than once, scopes of none to two names."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v[: n // 10] = v[0]
    ids = np.arange(n) * 2 + 1
    ids[n // 2 : n // 2 + 5] = ids[:5]
    scopes = [[str(x) for x in rng.integers(0, 9, rng.integers(0, 3))] for _ in range(n)]
    rows = [(int(i), [float(x) for x in e]) for i, e in zip(ids, v)]
    # Vectors travel with their place, as ids repeat.
    placed = pool(spark.createDataFrame([(k, e) for k, (_, e) in enumerate(rows)], "k bigint, e array<double>"), "k", "e")
    named = spark.createDataFrame([(k, i, s) for k, ((i, _), s) in enumerate(zip(rows, scopes))], "id bigint, own bigint, scope array<string>")
    return placed.join(named, "id").selectExpr("own AS id", "vec", "scope"), ids, v, scopes


def brute_counts(ids, v, scopes):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.minimum(u @ u.T, np.nextafter(1.0, 0.0))
    sims[(v[:, None, :] == v[None, :, :]).all(axis=2)] = 1.0
    sims[ids[:, None] == ids[None, :]] = -2.0
    shared = np.array([[bool(set(a) & set(b)) for b in scopes] for a in scopes])
    out = {(int(i), t): [0, 0] for i in ids for t in LEVELS}
    for k, i in enumerate(ids.tolist()):
        for t in LEVELS:
            out[i, t][0] += int((sims[k] >= t).sum())
            out[i, t][1] += int(((sims[k] >= t) & shared[k]).sum())
    return out


def counted(df):
    return {(r["id"], r["threshold"]): [r["n"], r["n_scoped"]] for r in df.collect()}


@pytest.mark.parametrize("grid", [Grid(), Grid(rows_per_cell=30), Grid(rows_per_cell=4, block_rows=9)], ids=["one block", "blocks", "small blocks"])
def test_counts_of_one_table_and_of_two_are_those_of_brute_force(spark, grid):
    rows, ids, v, scopes = rows_of(spark, 150)
    want = brute_counts(ids, v, scopes)
    assert counted(threshold_counts(rows, rows, LEVELS, grid)) == want
    assert counted(threshold_counts(rows, rows.select("*"), LEVELS, grid)) == want


def test_cells_that_prune_give_the_same_counts(spark):
    ids, v = clustered(400, 20)
    base, grid = based(spark, ids, v), Grid(rows_per_cell=16)
    assert bounds_prune(base, base, 0.95, 16, grid) and not bounds_prune(base, base, -0.9, 16, grid)
    rows = base.selectExpr("rep AS id", "vec", "array('x') AS scope")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95).sum(axis=1) - 1
    for queries in (rows, rows.select("*")):
        got = counted(threshold_counts(queries, rows, (0.95,), grid))
        assert got == {(int(i), 0.95): [n, n] for i, n in zip(ids, near.tolist())}


def test_rows_of_a_sweep_are_sent_as_often_at_any_size(spark, monkeypatch):
    """Lots in proportion to nothing the bounds could prune sent a row 32 times, more as the rows grew."""
    sent, members = {}, neighbour_ops._members

    def looked(*args):
        rows, load = members(*args)
        sent[size] = rows.count() / size
        return rows, load

    monkeypatch.setattr(neighbour_ops, "_members", looked)
    for size in (600, 2_400):
        ids, v = np.arange(size), np.random.default_rng(size).normal(size=(size, 24))
        rows = based(spark, ids, v).selectExpr("rep AS id", "vec", "array('x') AS scope")
        threshold_counts(rows, rows, (0.1,), Grid(rows_per_cell=40))
    assert sent == {600: 12, 2_400: 12}


def test_no_rows_no_counts(spark):
    rows = spark.createDataFrame([], "id bigint, vec array<double>, scope array<string>")
    assert threshold_counts(rows, rows, LEVELS).collect() == []


def test_components_are_read_for_the_orders_asked_for(spark, tmp_path):
    lines = {"l_orderkey": [1, 1, 1, 2, 2, 3, None], "l_partkey": [10, 11, 11, 10, None, 12, 10]}
    pq.write_table(pa.table(lines, pa.schema([(c, pa.int64()) for c in lines])), tmp_path / "lineitem.parquet")
    parts = {"p_partkey": [10, 11], "p_type": ["A", "B"], "p_name": ["x", "y"]}
    pq.write_table(pa.table(parts), tmp_path / "part.parquet")
    listed = lambda df: {r["odi_number"]: r["components"] for r in df.collect()}
    whole = listed(bindings.order_components(spark, str(tmp_path)))
    assert whole == {1: ["A: x", "B: y"], 2: ["A: x"], None: ["A: x"]}
    asked = spark.createDataFrame([(1,), (1,), (3,), (4,), (None,)], "odi_number bigint")
    assert listed(bindings.order_components(spark, str(tmp_path), asked)) == {1: whole[1]}

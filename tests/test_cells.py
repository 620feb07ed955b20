"""Two-level cells and the stored index: bounds, growth of what moves, partitions read, batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldpulse.operators.cells import Grid, build_cells, visits
from fieldpulse.operators.cluster import place_arrivals
from fieldpulse.operators.neighbours import group_copies, pool, preceding, self_units
from fieldpulse.operators.vector_index import VectorIndex
from fieldpulse.runtime import published, scratch_path
from test_neighbours import brute_grow, brute_neighbours, frame, listed, points, same_lists


def clustered(n, centres, dim=16, seed=1, width=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(centres, dim))
    v = middles[np.arange(n) % centres] + width * rng.normal(size=(n, dim))
    return np.arange(n) * 2 + 1, v


def based(spark, ids, v):
    return group_copies(frame(spark, ids, v), 1).table.select("rep", "vec")


def test_every_pair_within_the_floor_meets_and_far_cells_do_not(spark):
    ids, v = clustered(400, 20)
    grid, floor = Grid(rows_per_cell=4), 0.95
    cells = build_cells(based(spark, ids, v), 400, 16, grid)
    table = {r["cell"]: r for r in cells.table.collect()}
    assert sum(r["rows"] for r in table.values()) == 400 and 60 <= len(table) <= 140
    home = {r["rep"]: r["cell"] for r in cells.homes.collect()}
    seen = {int(i): set() for i in ids}
    for r in visits(cells.homes.drop("cell"), cells, floor, 16, grid, upward_only=False).collect():
        seen[r["rep"]] |= set(r["cells"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    close = u @ u.T >= floor
    for a, b in zip(*np.nonzero(close)):
        assert home[int(ids[b])] in seen[int(ids[a])]
    visited = sum(map(len, seen.values()))
    assert visited < 0.25 * 400 * len(table)
    for name, r in table.items():
        mine = [n for n, i in enumerate(ids) if home[int(i)] == name]
        angle = np.arccos(np.clip(u[mine] @ np.array(r["pivot"]), -1, 1)).max()
        assert angle == pytest.approx(r["radius"], abs=1e-7)


def test_rows_sent_follow_the_rows_on_clustered_vectors(spark, capsys):
    """Rows of a cell and their visits, at two sizes with clusters of the same density."""
    sent = {}
    for n in (1_000, 4_000):
        ids, v = clustered(n, n // 50, dim=24)
        _, load = self_units(based(spark, ids, v), n, 0.95, Grid(rows_per_cell=20))
        sent[n] = (n + load.visits) / n
        with capsys.disabled():
            print(f"\n{n} rows: {load.cells} cells, {load.units} units, {sent[n]:.2f} rows sent for each")
        assert load.cells >= n / 40
    # Four times the rows and cells: a join of blocks without cells would send each row to four times as many.
    assert sent[4_000] < 2.5 * sent[1_000]


def test_a_crowded_coarse_cell_is_split_into_parts(spark):
    ids, v = clustered(300, 1)
    grid = Grid(rows_per_cell=10, max_coarse=1, part_bytes=8 * 16 * 20)
    assert grid.rows_in_part(16) == 20
    cells = build_cells(based(spark, ids, v), 300, 16, grid)
    assert cells.homes.count() == 300 and cells.homes.select("rep").distinct().count() == 300
    plain = build_cells(based(spark, ids, v), 300, 16, Grid(rows_per_cell=10, max_coarse=1))
    assert cells.homes.select("rep", "cell").exceptAll(plain.homes.select("rep", "cell")).isEmpty()


def test_preceding_rows_match_brute_force(spark):
    ids, v = points(90, seed=4, copies=30)
    for grid in (Grid(), Grid(rows_per_cell=3, block_rows=7)):
        got = listed(preceding(frame(spark, ids, v), 0.8, 4, grid))
        near = brute_neighbours(ids, v, 0.8, 1_000)
        same_lists(got, {i: [(j, s) for j, s in l if j < i][:4] for i, l in near.items()})


def test_index_search_is_exact_and_survives_appends_and_reruns(spark):
    ids, v = points(160, seed=11, copies=25)
    order = np.argsort(ids)
    ids, v = ids[order], v[order]
    index = VectorIndex(spark, scratch_path(spark, "index"), 6, Grid(rows_per_cell=5, block_rows=9))
    with pytest.raises(ValueError):
        index.version()
    index.create(frame(spark, ids[:80], v[:80]))
    # What a failed append left behind is not seen and does not disturb its rerun.
    index.rows(0).limit(3).withColumn("coarse", F.lit(0)).drop("batch").write.partitionBy("coarse").parquet(f"{index.root}/rows/batch=1")
    before = {f for f in index.rows(0).inputFiles() if "batch=0" in f}
    index.append(frame(spark, ids[80:120], v[80:120]))
    index.append(frame(spark, ids[120:], v[120:]))
    index.append(frame(spark, ids[:1], v[:1]).filter("false"))
    assert published(spark, index.root) == [0, 1, 2, 3]
    assert {f for f in index.rows(3).inputFiles() if "batch=0" in f} == before
    asked = frame(spark, ids, v)
    same_lists(listed(index.search(asked, 0.8, 5)), brute_neighbours(ids, v, 0.8, 5))
    with pytest.raises(ValueError):
        index.search(asked, 0.8, 6)
    with pytest.raises(ValueError):
        index.create(asked)


def test_search_opens_the_coarse_cells_that_bounds_allow(spark):
    ids, v = clustered(600, 12, dim=24, width=0.02)
    index = VectorIndex(spark, scratch_path(spark, "index"), 6, Grid(rows_per_cell=5)).create(frame(spark, ids, v))
    cells = index._cells(0)
    asked = frame(spark, ids[:1], v[:1]).select(F.col("id").alias("rep"), "vec")
    came = visits(asked, cells, 0.95, 24, index.grid, upward_only=False)
    opened = index.allowed_rows(came, 0, cells.table)
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "coarse" in plan.split("PartitionFilters: [")[1].split("]")[0]
    coarse = {r["coarse"] for r in opened.select("coarse").distinct().collect()}
    there = {r["coarse"] for r in index.rows(0).select("coarse").distinct().collect()}
    assert len(coarse) <= 2 < len(there)
    read = opened.select("rep").count()
    assert read < 600 / 6
    assert [j for j, _ in listed(index.search(frame(spark, ids[:1], v[:1]), 0.95, 5))[1]] == [
        j for j, _ in brute_neighbours(ids, v, 0.95, 5)[1]
    ]


def test_batches_of_arrivals_end_up_as_one(spark):
    ids, v = points(140, seed=3)
    order = np.argsort(ids)
    ids, v = ids[order], v[order]
    formed, _ = brute_grow(brute_neighbours(ids[:80], v[:80], 0.9, 5))
    kept = {i: c for i, c in formed.items() if list(formed.values()).count(c) >= 5}
    near = brute_neighbours(ids, v, 0.9, 1_000)
    late = {int(i): [(j, s) for j, s in near[int(i)] if j < i][:5] for i in ids[80:]}
    want, _ = brute_grow(late, kept)
    for cuts in ([80, 140], [80, 100, 101, 140]):
        index = VectorIndex(spark, scratch_path(spark, "index"), 6, Grid(rows_per_cell=6)).create(frame(spark, ids[:80], v[:80]))
        owners = dict(kept)
        for a, b in zip(cuts, cuts[1:]):
            batch = frame(spark, ids[a:b], v[a:b])
            members = spark.createDataFrame(list(owners.items()), "i bigint, cluster bigint")
            placed = {r["i"]: r["cluster"] for r in place_arrivals(index, members, batch, 0.9, 5, 9).collect()}
            assert len(placed) == b - a
            owners |= placed
            index.append(batch)
        assert {int(i): owners[int(i)] for i in ids[80:]} == {int(i): want[int(i)] for i in ids[80:]}


def test_rows_sent_do_not_follow_the_cells_where_nothing_can_be_pruned(spark):
    """Three hundred cells that every row may visit: a row is sent to lots of them, not to each."""
    rng = np.random.default_rng(2)
    ids, v = np.arange(600), rng.normal(size=(600, 24))
    _, load = self_units(based(spark, ids, v), 600, 0.05, Grid(rows_per_cell=2))
    assert load.cells > 200 and load.visits < 20 * 600

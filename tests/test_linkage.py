"""One forest for every floor, scoped lists, coherence and delay against brute force on small rows."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_neighbours import brute_neighbours, frame, listed, points

from fieldpulse.operators import neighbours
from fieldpulse.operators.cluster import component_labels, linkage_forest
from fieldpulse.operators.neighbours import Grid, _tree_edges, scoped_search, spanning
from fieldpulse.plans.coherence import breaking_rank, coherence
from fieldpulse.plans.delay import completion, corrected_counts, triangle


def linked(ids, v, floor):
    """Smallest id reachable over pairs at or above the floor."""
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    close, low = u @ u.T >= floor, ids.copy()
    while True:
        spread = np.where(close, low[None, :], low.max()).min(axis=1)
        if np.array_equal(spread, low):
            return {int(i): int(c) for i, c in zip(ids, low)}
        low = spread


def test_forests_of_units_hold_the_components_of_every_floor():
    """What the units of several blocks keep, without Spark; the registered query runs the rounds over it."""
    ids, v = points(70, dim=6, seed=5)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    blocks = np.arange(len(ids)) % 3
    edges = []
    for a in range(3):
        for b in range(a, 3):
            held = (blocks == a) | (blocks == b)
            unit = pa.table({
                "blk": blocks[held].astype(np.int32), "a": np.full(held.sum(), a, np.int32), "b": np.full(held.sum(), b, np.int32),
                "rep": ids[held], "vec": pa.array(list(u[held])),
            })
            kept = _tree_edges(0.8)(unit).to_pylist()
            assert len(kept) < held.sum()
            edges += kept
    sizes = set()
    for floor in (0.8, 0.9, 0.97, 0.99):
        low = {int(i): int(i) for i in ids}
        for _ in ids:
            for e in edges:
                if e["sim"] >= floor:
                    low[e["u"]] = low[e["v"]] = min(low[e["u"]], low[e["v"]])
        assert low == linked(ids, v, floor)
        sizes.add(len(set(low.values())))
    assert len(sizes) == 4


def started_jobs(spark, group, run):
    """What ``run`` returns and how many jobs it started."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("tail", [0, 3, 1_000])
def test_labels_of_long_ways_take_few_rounds(spark, tail):
    """A way of 150 nodes in ascending order took a round for about every second of them."""
    way = [(10 * k, 10 * k + 10) for k in range(150)]
    edges = [*way, *[(5, 7 + 10 * k) for k in range(20)], (9_001, 9_000), (9_001, 9_001)]
    nodes = sorted({x for e in edges for x in e} | {4, 8_000})
    labels, jobs = started_jobs(spark, f"way-{tail}", lambda: component_labels(
        spark.createDataFrame([(n,) for n in nodes], "u bigint"), spark.createDataFrame(edges, "u bigint, v bigint"), tail
    ).collect())
    want = {n: 0 if n % 10 == 0 and n <= 1_500 else 5 if n == 5 or n % 10 == 7 else 9_000 if n > 9_000 else n for n in nodes}
    assert {r["u"]: r["label"] for r in labels} == want
    assert jobs < 200


@pytest.mark.parametrize("tail", [0, 20, 1_000])
def test_forest_rounds_and_their_tail_give_the_components_of_every_floor(spark, tail):
    ids, v = points(70, dim=6, seed=5, copies=4)
    forest = linkage_forest(frame(spark, ids, v), 0.8, Grid(rows_per_cell=30, block_rows=25), tail)
    edges = forest.edges.collect()
    assert len({(e["u"], e["v"]) for e in edges}) == len(edges) < len(ids)
    for floor in (0.8, 0.97):
        got = {r["id"]: r["component"] for r in forest.components(floor).collect()}
        assert got == linked(ids, v, floor)


def test_spanning_keeps_a_forest_of_the_greatest_sums():
    rng = np.random.default_rng(8)
    u, v = rng.integers(0, 60, 400), rng.integers(0, 60, 400)
    sim = np.round(rng.random(400), 1)
    kept, ids, lows = spanning(u, v, sim)
    low, want = {int(i): int(i) for i in ids}, 0.0
    for e in np.argsort(-sim, kind="stable"):
        a, b = low[int(u[e])], low[int(v[e])]
        if a != b:
            want += sim[e]
            low = {i: min(a, b) if c in (a, b) else c for i, c in low.items()}
    assert dict(zip(ids.tolist(), lows.tolist())) == low
    assert sim[kept].sum() == pytest.approx(want) and len(kept) == len(ids) - len(set(low.values()))


def test_scoped_lists_are_full_where_a_filter_after_the_cut_is_not(spark):
    ids, v = points(90, seed=9)
    scope = {int(i): ["A"] if n % 3 else ["B", "C"] if n % 2 else [] for n, i in enumerate(ids)}
    names = spark.createDataFrame(list(scope.items()), "id bigint, scope array<string>")
    rows = frame(spark, ids, v).join(names, "id")
    near = brute_neighbours(ids, v, 0.5, 1_000)
    want = {i: [j for j, _ in l if set(scope[i]) & set(scope[j])][:4] for i, l in near.items()}
    for grid in (Grid(), Grid(rows_per_cell=9, block_rows=8)):
        got = {i: [j for j, _ in l] for i, l in listed(scoped_search(rows, rows, 0.5, 4, grid)).items()}
        assert got == {i: l for i, l in want.items() if l}
    assert any(len([j for j, _ in near[i][:4] if set(scope[i]) & set(scope[j])]) < len(want[i]) for i in near)


def test_coherence_equals_the_mean_over_all_pairs(spark):
    ids, v = points(60, seed=2, copies=5)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    held = {int(i): n % 3 for n, i in enumerate(ids)}
    rows = [(p, i, float(i % 7)) for i, p in held.items()] + [(8, int(ids[0]), 1.0), (9, 10**6, 1.0)]
    members = spark.createDataFrame(rows, "pattern_id bigint, odi_number bigint, similarity double")
    got = {r["pattern_id"]: (r["vectors"], r["coherence"]) for r in coherence(members, frame(spark, ids, v)).collect()}
    broken = {r["pattern_id"]: (r["looked_at"], r["breaks_at"]) for r in breaking_rank(members, frame(spark, ids, v), 0.3, 10).collect()}
    assert got[8] == (1, None) and broken[8] == (1, None) and 9 not in got
    for p in range(3):
        mine = sorted((-(i % 7), i, u[n]) for n, i in enumerate(map(int, ids)) if held[i] == p)
        sims = [float(a[2] @ b[2]) for k, a in enumerate(mine) for b in mine[:k]]
        assert got[p] == (len(mine), pytest.approx(np.mean(sims)))
        means = [np.mean([x[2] @ mine[k][2] for x in mine[:k]]) for k in range(1, 10)]
        assert broken[p] == (10, next((k + 2 for k, m in enumerate(means) if m < 0.3), None))


def test_delay_corrects_the_newest_windows(spark):
    """Half of each window's reports come at once, a quarter one window later, a quarter two windows later."""
    start, rows = dt.date(2024, 1, 1), []
    for origin in range(6):
        for delay, n in ((0, 8), (1, 4), (2, 4)):
            day = start + dt.timedelta(days=10 * origin + 3)
            rows += [("a", day, day + dt.timedelta(days=10 * delay))] * n
    rows += [("a", None, start), ("a", start, None), ("a", start, start - dt.timedelta(days=1)), ("b", start, start)]
    df = spark.createDataFrame(rows, "g string, i date, f date")
    cells = triangle(df, "i", "f", ["g"], start, dt.date(2024, 2, 29), 10)
    assert cells.filter("g = 'a'").count() == 21 and cells.filter("g = 'b'").agg(F.sum("n")).first()[0] == 1
    shares = {r["delay"]: r["complete"] for r in completion(cells.filter("g = 'a'"), ["g"]).collect()}
    assert shares == pytest.approx({0: 0.5, 1: 0.75, 2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0})
    counts = {r["origin"]: (r["known"], r["expected"]) for r in corrected_counts(cells, ["g"]).filter("g = 'a'").collect()}
    assert counts[5] == (8, pytest.approx(16.0)) and counts[4] == (12, pytest.approx(16.0)) and counts[0] == (16, pytest.approx(16.0))
    with pytest.raises(ValueError):
        triangle(df, "i", "f", ["g"], start, start, 10)


def test_rows_that_share_a_name_whatever_part_of_the_entries_is_looked_at(monkeypatch):
    rng = np.random.default_rng(4)
    left, right = ([[f"n{x}" for x in rng.integers(0, 12, rng.integers(0, 4))] for _ in range(n)] for n in (30, 45))
    for places in (3, 1_000_000):
        monkeypatch.setattr(neighbours, "_PLACES", places)
        rows, cols, names = neighbours._scope_entries(left, right)
        found = np.concatenate([neighbours._sharing(rows, cols, names, slice(a, a + 10), 45) for a in (0, 10, 20)])
        assert found.tolist() == [[bool(set(a) & set(c)) for c in right] for a in left]

"""Exact neighbour join and growth against brute force, with copies, hot groups and small blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldpulse.operators import neighbours as neighbour_ops
from fieldpulse.operators.cluster import (
    _decide,
    assign_new,
    connected_components,
    formation_report,
    grow,
    range_count,
    resolve_in_order,
)
from fieldpulse.operators.neighbours import Grid, neighbours, pool, search, threshold_counts
from fieldpulse.runtime import dense_ids

SMALL = Grid(rows_per_cell=4, block_rows=8, max_coarse=6, part_bytes=700)


def points(n, dim=4, seed=0, copies=0):
    """Random vectors around a few centres; the first ``copies`` rows are one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    v = centres[rng.integers(0, 5, n)] + 0.35 * rng.normal(size=(n, dim))
    v[:copies] = v[0]
    ids = rng.permutation(n) * 3 + 1
    return ids, v


def frame(spark, ids, v):
    rows = [(int(i), [float(x) for x in r]) for i, r in zip(ids, v)]
    return pool(spark.createDataFrame(rows, "k bigint, e array<double>"), "k", "e")


def brute_neighbours(ids, v, floor, cap):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for a in range(len(ids)):
        found = []
        for c in range(len(ids)):
            if a == c:
                continue
            same = bool(np.array_equal(v[a], v[c]))
            sim = 1.0 if same else min(1.0, float(u[a] @ u[c]))
            if sim >= floor:
                found.append((not same, -sim, int(ids[c])))
        out[int(ids[a])] = [(j, -s) for _, s, j in sorted(found)[:cap]]
    return out


def brute_grow(near, start=None):
    owner, strength = dict(start or {}), {}
    for i in sorted(near):
        support = {}
        for j, sim in near[i]:
            if j in owner:
                n, best = support.get(owner[j], (0, sim))
                support[owner[j]] = (n + 1, best)
        if support:
            owner[i] = max(support, key=support.get)
            strength[i] = support[owner[i]][1]
        else:
            owner[i], strength[i] = i, 1.0
    return owner, strength


def listed(df):
    out = {}
    for r in df.orderBy("i", "rk").collect():
        out.setdefault(r["i"], []).append((r["j"], r["sim"]))
    return out


def same_lists(got, want):
    assert {i: [j for j, _ in l] for i, l in got.items()} == {i: [j for j, _ in l] for i, l in want.items() if l}
    for i, l in got.items():
        assert [s for _, s in l] == pytest.approx([s for _, s in want[i]])


@pytest.mark.parametrize("copies", [0, 3, 40])
@pytest.mark.parametrize("grid", [Grid(), SMALL], ids=["one block", "many cells"])
def test_neighbours_match_brute_force(spark, copies, grid):
    ids, v = points(120, seed=copies, copies=copies)
    same_lists(listed(neighbours(frame(spark, ids, v), 0.9, 5, grid)), brute_neighbours(ids, v, 0.9, 5))


def test_floor_is_inclusive_and_zero_vectors_drop(spark):
    ids, v = np.array([1, 2, 3, 4]), np.array([[1.0, 0.0], [0.5, np.sqrt(0.75)], [0.0, 0.0], [1.0, 0.0]])
    got = listed(neighbours(frame(spark, ids, v), 0.5, 5))
    assert [j for j, _ in got[1]] == [4, 2]
    assert 3 not in got
    assert neighbours(frame(spark, ids, v), 0.5, 1).count() == 3


@pytest.mark.parametrize("copies, block_rows", [(0, 1000), (0, 15), (40, 1000), (40, 10)])
def test_growth_matches_ordered_loop(spark, copies, block_rows):
    ids, v = points(150, seed=7 + copies, copies=copies)
    got = grow(frame(spark, ids, v), 0.9, 5, SMALL, block_rows).collect()
    owner, strength = brute_grow(brute_neighbours(ids, v, 0.9, 5))
    assert {r["i"]: r["cluster"] for r in got} == owner
    assert {r["i"]: r["join_sim"] for r in got} == pytest.approx(strength)


def test_votes_and_ties(spark):
    edges = {2: [(1, 0.90)], 4: [(3, 0.88)], 5: [(3, 0.95), (2, 0.82), (1, 0.80)],
             6: [(3, 0.85), (1, 0.80)], 8: [(4, 0.81), (7, 0.81)]}
    rows = [(i, j, s, rk, None) for i, l in edges.items() for rk, (j, s) in enumerate(l, 1)]
    votes = spark.createDataFrame(rows, "i bigint, j bigint, sim double, rk int, cluster bigint")
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "i bigint")
    for block_rows in (100, 2):
        got = {r["i"]: (r["cluster"], r["join_sim"]) for r in resolve_in_order(nodes, votes, 8, block_rows).collect()}
        assert got == {1: (1, 1.0), 2: (1, 0.9), 3: (3, 1.0), 4: (3, 0.88), 5: (1, 0.82),
                       6: (3, 0.85), 7: (7, 1.0), 8: (3, 0.81)}
    report = formation_report(resolve_in_order(nodes, votes, 8), 3).first().asDict()
    assert report == {"pool_size": 8, "patterns_formed": 2, "patterns_discarded_below_min": 1,
                      "members_assigned": 7, "members_unassigned": 1}


def test_new_rows_join_existing_patterns(spark):
    ids, v = points(140, seed=3)
    old, new = slice(0, 100), slice(100, 140)
    formed, _ = brute_grow(brute_neighbours(ids[old], v[old], 0.9, 5))
    sizes = {c: list(formed.values()).count(c) for c in formed.values()}
    kept = {i: c for i, c in formed.items() if sizes[c] >= 5}
    members = spark.createDataFrame([(i, c) for i, c in kept.items()], "i bigint, cluster bigint")
    got = assign_new(frame(spark, ids[new], v[new]), frame(spark, ids[old], v[old]), members, 0.9, 5, SMALL, 9).collect()
    near = brute_neighbours(ids, v, 0.9, 5)
    want, _ = brute_grow({int(i): near[int(i)] for i in ids[new]}, kept)
    assert {r["i"]: r["cluster"] for r in got} == {int(i): want[int(i)] for i in ids[new]}


@pytest.mark.parametrize("copies", [0, 40])
def test_components_match_union_find(spark, copies):
    ids, v = points(120, dim=6, seed=5, copies=copies)
    parent = {int(i): int(i) for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, l in brute_neighbours(ids, v, 0.95, 1000).items():
        for j, _ in l:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    got = connected_components(frame(spark, ids, v), 0.95, SMALL).collect()
    assert {r["id"]: r["component"] for r in got} == {i: root(i) for i in parent}


def test_search_and_counts(spark):
    ids, v = points(90, seed=9, copies=10)
    units = frame(spark, ids, v)
    picked = [int(i) for i in ids[5:20]]
    near = brute_neighbours(ids, v, 0.8, 1000)
    got = listed(search(units.filter(units.id.isin(picked)), units, 0.8, 4, SMALL))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    at = {int(i): n for n, i in enumerate(ids)}
    for i in picked:
        sims = [s for _, s in got.get(i, [])]
        want = sorted((float(u[at[i]] @ u[at[j]]) for j, _ in near[i]), reverse=True)[:4]
        assert sims == pytest.approx(want)
    scope = {int(i): ["A"] if n % 2 else (["A", "B"] if n % 3 else []) for n, i in enumerate(ids)}
    scopes = spark.createDataFrame(list(scope.items()), "id bigint, scope array<string>")
    rows = units.join(scopes, "id")
    counts = {(r["id"], r["threshold"]): (r["n"], r["n_scoped"]) for r in threshold_counts(rows, rows, (0.8, 0.95), SMALL).collect()}
    for i in near:
        for t in (0.8, 0.95):
            hit = [j for j, s in near[i] if s >= t]
            assert counts[(i, t)] == (len(hit), sum(bool(set(scope[i]) & set(scope[j])) for j in hit))


def test_dense_ids(spark):
    df = spark.range(0, 1000, 7).selectExpr("id * 5 AS k").repartition(5)
    got = [tuple(r) for r in dense_ids(df, "k", "n").orderBy("k").select("k", "n").collect()]
    assert got == [(k * 5, n) for n, k in enumerate(range(0, 1000, 7), 1)]


def test_identical_vectors_are_alike_to_every_operator(spark):
    rng = np.random.default_rng(9)
    kinds = [list(map(float, rng.normal(size=7))) for _ in range(12)]
    rows = [(n, kinds[n % 12 if n % 3 else 0]) for n in range(60)]
    units = pool(spark.createDataFrame(rows, "k bigint, e array<double>"), "k", "e")
    same = {(i, j) for i, a in rows for j, b in rows if i != j and a == b}
    for grid in (Grid(), Grid(block_rows=5, rows_per_cell=6)):
        for found in (neighbours(units, 1.0, 60, grid), search(units, units, 1.0, 60, grid)):
            got = found.collect()
            assert {(r["i"], r["j"]) for r in got} == same and {r["sim"] for r in got} == {1.0}
        scoped = units.withColumn("scope", F.array(F.lit("x")))
        counts = {r["id"]: (r["n"], r["n_scoped"]) for r in threshold_counts(scoped, scoped, (1.0,), grid).collect()}
        assert counts == {i: (sum(a == i for a, _ in same),) * 2 for i, _ in rows}


def test_small_ranges_grow_with_the_rows():
    assert [range_count(n, 50) for n in (0, 40, 500, 10_256, 100_000)] == [1, 1, 10, 32, 32]
    assert range_count(1_000_000, 50) == range_count(1_000_000, 10_000) == 100


@pytest.mark.parametrize("held", [5, 10**6])
def test_one_product_gives_the_best_of_both_sides(monkeypatch, held):
    """The lists of either side equal those of a product of its own, ties by the smaller id."""
    monkeypatch.setattr(neighbour_ops, "_HELD", held)
    monkeypatch.setattr(neighbour_ops, "_chunks", lambda n, width: iter([slice(a, min(n, a + 7)) for a in range(0, n, 7)]))
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(90, 3)), 0) + 0.01
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.sort(rng.permutation(500)[:90])
    left, right = (neighbour_ops._Side(ids[s], v[s], None, None) for s in (slice(0, 40), slice(40, 90)))
    for floor, cap in ((0.1, 2), (0.5, 4), (0.99, 60)):
        rows = lambda found: [tuple(x) for x in zip(*(np.concatenate(c).tolist() for c in zip(*found)))]
        want = {}
        for a, b in ((left, right), (right, left)):
            for i, x in zip(a.ids.tolist(), a.vecs):
                sims = np.minimum(b.vecs @ x, np.nextafter(1.0, 0.0))
                order = sorted((-round(s, 12), j) for s, j in zip(sims, b.ids.tolist()) if s >= floor)
                want[i] = [s for s, _ in order[:cap]]
        got = {}
        for i, _, s in rows(neighbour_ops._best_both(left, right, floor, cap)):
            got.setdefault(i, []).append(-round(s, 12))
        assert {i: sorted(l) for i, l in got.items()} == {i: l for i, l in want.items() if l}


def test_entries_beyond_the_cap_go_before_the_sort_and_none_of_the_best():
    rng = np.random.default_rng(3)
    row, col = (x.ravel() for x in np.indices((20, 300)))
    for sim in (np.round(rng.random(6_000), 2), np.full(6_000, 0.5), rng.random(6_000)):
        want = [r * 300 + c for r in range(20) for _, c in sorted((-sim[r * 300 + c], c) for c in range(300))[:7]]
        assert neighbour_ops._top(row, col, sim, 20, 7).tolist() == want


def test_a_range_hands_back_the_votes_of_rows_that_wait():
    """Row 5 listens to 3 of its own range, row 7 to 1 of another one; a round read and sorted all votes again for that."""
    votes = pd.DataFrame({
        "block": [4] * 4, "i": [7, 5, 3, 7], "j": [1, 3, 2, 5], "sim": [0.4, 0.6, 0.5, 0.9], "rk": [2, 1, 1, 1], "cluster": [-1, -1, 2, -1],
    })
    looked = _decide(votes)
    assert looked[looked.rk < 0][["block", "i", "cluster", "join_sim"]].values.tolist() == [[4, 3, 2, 0.5], [4, 5, 2, 0.6]]
    assert looked[looked.rk > 0][["block", "i", "j", "sim", "rk", "cluster"]].values.tolist() == [[4, 7, 5, 0.9, 1, -1], [4, 7, 1, 0.4, 2, -1]]

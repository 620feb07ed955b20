"""Exact similarity joins over dense vectors.

All neighbour searches share one shape:

1. identical vectors collapse to one group row that keeps its ``cap + 1`` smallest
   ids, which is all a capped neighbour list can ever show of them;
2. group rows live in cells on two levels, whose number follows the rows, and visit the
   other cells that their bounds allow (:mod:`fieldpulse.operators.cells`), so pairs
   that cannot match never meet;
3. lots of cells and their visitors are cut into blocks of bounded size, and every (block, block)
   unit is one Spark group whose similarities are a single matrix product;
4. a unit returns only its partial answer (top-k per row, counts per row, or a
   spanning star), and a second aggregation merges the partial answers exactly.

No step emits all pairs of a cell, and a cell that holds most of the rows is
spread over as many units as its size asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fieldpulse import settings
from fieldpulse.functions.vectors import norm, unit
from fieldpulse.operators.cells import Cells, Grid, bounds_prune, build_cells, in_lots, matrix, one_cell, visits
from fieldpulse.runtime import as_table


def pool(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vec)`` with unit vectors; missing and zero vectors match nothing and drop."""
    raw = df.filter(F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(vector_col).cast("array<double>").alias("raw"),
    )
    return raw.filter(norm(F.col("raw")) > 0).select("id", unit(F.col("raw")).alias("vec"))


def with_vector_key(df: DataFrame) -> DataFrame:
    """A hash ahead of the vector keeps sorts and joins on it cheap; both are compared."""
    return df.withColumn("_vh", F.xxhash64("vec"))


@dataclass(frozen=True)
class Groups:
    """Identical vectors collapsed: ``table(rep, vec, ids, copies)``."""

    table: DataFrame
    rows: int
    heads: int
    groups: int

    @property
    def has_copies(self) -> bool:
        return self.rows > self.groups

    @property
    def has_followers(self) -> bool:
        """Some vector has more copies than its id list keeps."""
        return self.rows > self.heads


def group_copies(units: DataFrame, keep: int) -> Groups:
    """One row per distinct vector with its ``keep`` smallest ids.

    ``row_number() <= keep`` is limited before the shuffle, so a vector shared by a
    third of all rows sends at most ``keep`` rows per map task.
    """
    by_vec = Window.partitionBy("_vh", "vec").orderBy("id")
    whole = by_vec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Counted on the way through, which saves a pass over the vectors. A rerun task may count
    # twice; a count that is too high only costs the joins for copies that are not there.
    seen = Observation()
    counted = with_vector_key(units.observe(seen, F.count(F.lit(1)).alias("rows")))
    ranked = counted.withColumn("_rn", F.row_number().over(by_vec))
    heads = ranked.filter(F.col("_rn") <= keep)
    # The second window reuses the first one's shuffle; a group has at most `keep` rows by now.
    table = as_table(
        heads.withColumn("ids", F.collect_list("id").over(whole))
        .filter(F.col("_rn") == 1)
        .select(F.col("id").alias("rep"), "vec", "ids"),
        "groups",
    )
    sizes = table.agg(F.count("*").alias("g"), F.sum(F.size("ids")).alias("h")).first()
    # An input known to be empty is planned without the count.
    rows = seen.get["rows"] if sizes["g"] else 0
    return Groups(table, rows, int(sizes["h"] or 0), int(sizes["g"]))


# --- cells and blocks ------------------------------------------------------------


@dataclass(frozen=True)
class Load:
    """Size of a block join: cells, visits to lots of them, and (block, block) units."""

    cells: int
    visits: int
    units: int


def dimension(rows: DataFrame) -> int:
    first = rows.select(F.size("vec")).first()
    return first[0] if first else 1


def _members(cells: Cells, base: DataFrame, visitors: DataFrame | None, dim: int, grid: Grid) -> tuple[DataFrame, Load]:
    """Rows ``(cell, a, b, blk, rep, vec, ...)``: every unit of the join with its members.

    ``visitors`` are rows with a list of ``cells``. The rows of a cell are compared among themselves only in a
    self-join, where the visitors are rows of the base.
    """
    among = visitors is None or "_query" not in visitors.columns
    homes = cells.homes.select("cell", *base.columns).withColumn("visitor", F.lit(False))
    held = cells.table.groupBy("cell").agg(F.sum("rows").alias("h"), F.count("*").alias("n")).filter("h > 0")
    if visitors is None:
        spots, sizes = homes, held.withColumn("v", F.lit(0).cast("bigint"))
    else:
        came = visitors.select("rep", "vec", *[c for c in base.columns if c not in ("rep", "vec")], F.explode("cells").alias("cell"))
        counts = visitors.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("v"))
        spots = homes.unionByName(came.withColumn("visitor", F.lit(True)))
        sizes = held.join(counts, "cell", "left").select("cell", "h", "n", F.coalesce("v", F.lit(0)).alias("v"))
    own = F.col("_h") * (F.col("_h") + 1) / 2 if among else F.lit(0)
    if cells.single is not None:
        came = 0 if visitors is None else visitors.count()
        n = max(cells.single, came)
        # More rows than a cell has are in one because cells would not prune.
        rows = grid.rows_in_lot(n, dim) if cells.single <= grid.rows_per_cell else grid.rows_in_side(n, dim)
        h, v = -(-cells.single // rows), -(-came // rows)
        load = Load(1, came, (h * (h + 1) // 2 if among else 0) + h * v)
        spots = spots.withColumns({"_h": F.lit(h), "_v": F.lit(v)})
    else:
        rows = grid.rows_in_block(dim) if cells.lots is None else cells.lots.side
        sizes = as_table(sizes.select(
            "cell", "v", "n", F.ceil(F.col("h") / rows).cast("int").alias("_h"), F.ceil(F.col("v") / rows).cast("int").alias("_v")
        ), "cells-sizes")
        told = sizes.agg(F.sum("n").alias("cells"), F.sum("v").alias("visits"), F.sum(own + F.col("_h") * F.col("_v")).alias("units")).first()
        load = Load(int(told["cells"] or 0), int(told["visits"] or 0), int(told["units"] or 0))
        spots = spots.join(sizes.drop("v", "n"), "cell")

    spread = F.xxhash64(F.lit("block"), F.col("rep"))
    blk = F.col("blk")
    spots = spots.withColumn(
        "blk",
        F.when(F.col("visitor"), F.col("_h") + F.pmod(spread, F.greatest("_v", F.lit(1))))
        .otherwise(F.pmod(spread, F.col("_h")))
        .cast("int"),
    )
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
        F.array().cast("array<int>")
    )
    with_visitors = F.transform(
        upto(F.col("_v")), lambda v: F.struct(blk.alias("a"), (F.col("_h") + v).alias("b"))
    )
    among_homes = F.transform(
        upto(F.col("_h")),
        lambda h: F.struct(F.least(blk, h).alias("a"), F.greatest(blk, h).alias("b")),
    )
    as_visitor = F.transform(upto(F.col("_h")), lambda h: F.struct(h.alias("a"), blk.alias("b")))
    as_home = F.concat(among_homes, with_visitors) if among else with_visitors
    members = (
        spots.withColumn("_u", F.explode(F.when(F.col("visitor"), as_visitor).otherwise(as_home)))
        .withColumn("a", F.col("_u.a"))
        .withColumn("b", F.col("_u.b"))
        .drop("_h", "_v", "_u", "visitor")
    )
    parts = int(max(1, min(load.units, grid.max_partitions)))
    # An explicit count keeps adaptive execution from merging heavy units into one task.
    return members.repartition(parts, "cell", "a", "b"), load


def self_units(base: DataFrame, n: int, floor: float, grid: Grid) -> tuple[DataFrame, Load]:
    """Units in which every two rows of ``base (rep, vec, ...)`` that can reach the floor meet once."""
    return self_members(build_cells(base, n, dimension(base), grid), base, floor, grid)


def self_members(cells: Cells, base: DataFrame, floor: float, grid: Grid) -> tuple[DataFrame, Load]:
    dim = dimension(base)
    cells = in_lots(cells, dim, grid)
    met = None if cells.single is not None else visits(cells.homes, cells, floor, dim, grid, upward_only=True)
    return _members(cells, base, met, dim, grid)


def query_units(cells: Cells, queries: DataFrame, floor: float, grid: Grid, extra: tuple[str, ...] = ("vh",)) -> tuple[DataFrame, Load]:
    """Units in which every query row meets the rows of the cells that its bounds allow."""
    dim = dimension(queries)
    cells = in_lots(cells, dim, grid)
    came = visits(queries, cells, floor, dim, grid, upward_only=False)
    return query_members(cells, came, dim, grid, extra)


def fitting_cells(queries: DataFrame, base: DataFrame, floor: float, grid: Grid) -> Cells:
    """Cells of the base where bounds of the floor prune, else one cell: what moves then follows the rows alone."""
    n, dim = base.count(), dimension(base)
    divided = n > grid.rows_per_cell and bounds_prune(queries, base, floor, dim, grid)
    return build_cells(base, n, dim, grid) if divided else one_cell(base, n, dim)


def query_members(cells: Cells, came: DataFrame, dim: int, grid: Grid, extra: tuple[str, ...] = ("vh",)) -> tuple[DataFrame, Load]:
    return _members(cells, cells.homes.select("rep", "vec", *extra), came.withColumn("_query", F.lit(True)), dim, grid)


def _chunks(n: int, width: int) -> Iterator[slice]:
    step = max(1, 4_000_000 // max(1, width))
    for start in range(0, n, step):
        yield slice(start, min(n, start + step))


@dataclass(frozen=True)
class _Side:
    """The rows of one block by id: ids, vectors and, where asked for, hashes of vectors or scopes."""

    ids: np.ndarray
    vecs: np.ndarray
    hashes: np.ndarray | None
    scopes: list | None

    def __len__(self) -> int:
        return len(self.ids)


def _sides(table: pa.Table) -> tuple[_Side, _Side | None]:
    """Members of block ``a`` and of block ``b`` (None when the unit is one block)."""
    blk, a, b = table["blk"].to_numpy(), table["a"][0].as_py(), table["b"][0].as_py()

    def side(number: int) -> _Side:
        held = table.filter(pa.array(blk == number))
        order = np.argsort(held["rep"].to_numpy(), kind="stable")
        column = lambda name: held[name].to_numpy()[order] if name in held.schema.names else None
        scopes = held["scope"].take(pa.array(order)).to_pylist() if "scope" in held.schema.names else None
        vecs = matrix(held["vec"])[order] if held.num_rows else np.zeros((0, 1))
        return _Side(column("rep"), vecs, column("vh"), scopes)

    return (side(a), None) if a == b else (side(a), side(b))


_BELOW_ONE = float(np.nextafter(1.0, 0.0))


def _cosines(rows: _Side, cols: _Side, part: slice) -> np.ndarray:
    """Cosines of unit vectors: one for identical vectors, below one for all others.

    Products are off by rounding on either side of one, whichever vectors they are of. Vectors of
    sides without hashes are all different. What a row has in common with itself is left as it is.
    """
    sims = np.minimum(rows.vecs[part] @ cols.vecs.T, _BELOW_ONE)
    if rows.hashes is not None and cols.hashes is not None:
        by_hash = np.argsort(cols.hashes, kind="stable")
        ordered = cols.hashes[by_hash]
        first = np.searchsorted(ordered, rows.hashes[part], "left")
        last = np.searchsorted(ordered, rows.hashes[part], "right")
        for r in np.flatnonzero(last - first > (1 if rows is cols else 0)):
            same = by_hash[first[r] : last[r]]
            same = same[(cols.vecs[same] == rows.vecs[part][r]).all(axis=1)]
            sims[r, same] = 1.0
    return sims


# Steps of similarity by which entries beyond the cap are told before they are sorted.
_LEVELS = 64


def _top(row: np.ndarray, col: np.ndarray, sim: np.ndarray, rows: int, cap: int) -> np.ndarray:
    """Places of the ``cap`` best entries of each row by similarity, then column, in that order."""
    at = np.arange(len(row))
    if len(row) > 2 * cap * rows:
        # Whoever has `cap` entries on higher steps cannot be among the best; a sort of all would cost more than the product.
        low, high = sim.min(), sim.max()
        level = ((sim - low) * ((_LEVELS - 1) / max(high - low, 1e-12))).astype(np.int64)
        counts = np.bincount(row * _LEVELS + level, minlength=rows * _LEVELS).reshape(rows, _LEVELS)
        enough = counts[:, ::-1].cumsum(axis=1) >= cap
        least = enough.sum(axis=1) - 1
        at = np.flatnonzero(level >= least[row])
        row, col, sim = row[at], col[at], sim[at]
    order = np.lexsort((col, -sim, row))
    row = row[order]
    return at[order[np.arange(len(row)) - np.searchsorted(row, row) < cap]]


def _reaching(sims: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the entries from ``floor`` on."""
    flat = sims.ravel()
    at = np.flatnonzero(flat >= floor)
    r = at // max(1, sims.shape[1])
    return r, at - r * sims.shape[1], flat[at]


def _best(rows: _Side, cols: _Side, floor: float, cap: int, exclude: str, scoped: bool = False):
    """Top ``cap`` columns per row by similarity, then id.

    ``exclude`` is ``own`` for a row's own id, ``later`` for that and all greater ones, or empty. ``scoped`` rows
    look at columns that share a name with them only.
    """
    out = []
    mine, theirs, names = _scope_entries(rows.scopes, cols.scopes) if scoped else (None, None, 0)
    for part in _chunks(len(rows), len(cols)):
        r, c, s = _reaching(_cosines(rows, cols, part), floor)
        ids = rows.ids[part]
        if exclude or scoped:
            held = ids[r] != cols.ids[c] if exclude == "own" else ids[r] > cols.ids[c] if exclude == "later" else np.ones(len(r), bool)
            if scoped:
                held &= _sharing(mine, theirs, names, part, len(cols))[r, c]
            r, c, s = r[held], c[held], s[held]
        best = _top(r, c, s, len(ids), cap)
        out.append((ids[r[best]], cols.ids[c[best]], s[best]))
    return out


# Entries of the other way that a unit holds before it reduces them to the best.
_HELD = 2_000_000


def _best_both(left: _Side, right: _Side, floor: float, cap: int):
    """Top ``cap`` of the other side for the rows of both, from one product; no vector is on both sides."""
    out = []
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    waiting = 0

    def reduced() -> tuple[np.ndarray, ...]:
        c, r, s = (np.concatenate(x) for x in zip(*held))
        best = _top(c, r, s, len(left), cap)
        return c[best], r[best], s[best]

    for part in _chunks(len(right), len(left)):
        r, c, s = _reaching(right.vecs[part] @ left.vecs.T, floor)
        s, r = np.minimum(s, _BELOW_ONE), r + part.start
        some = (s >= floor) & (right.ids[r] != left.ids[c])
        r, c, s = r[some], c[some], s[some]
        best = _top(r - part.start, c, s, part.stop - part.start, cap)
        out.append((right.ids[r[best]], left.ids[c[best]], s[best]))
        held.append((c, r, s))
        waiting += len(r)
        if waiting >= _HELD:
            held, waiting = [reduced()], 0
    c, r, s = reduced()
    return [*out, (left.ids[c], right.ids[r], s)]


_PAIRS = "rep bigint, other bigint, sim double"


def _top_pairs(floor: float, cap: int, both_ways: bool, exclude: str = "own", scoped: bool = False):
    def kernel(table: pa.Table) -> pa.Table:
        left, right = _sides(table)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if right is None:
            found += _best(left, left, floor, cap, exclude)
        elif len(left) and len(right):
            if both_ways:
                found += _best_both(left, right, floor, cap)
            else:
                found += _best(right, left, floor, cap, exclude, scoped)
        rep, other, sim = (np.concatenate(x) for x in zip(*found))
        return pa.table({"rep": rep, "other": other, "sim": sim})

    return kernel


def keep_top(pairs: DataFrame, key: str, other: str, cap: int) -> DataFrame:
    """The ``cap`` most similar rows of each key with their rank, ties by the smaller id."""
    order = Window.partitionBy(key).orderBy(F.col("sim").desc(), F.col(other))
    return pairs.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= cap)


def group_neighbours(
    groups: Groups, floor: float, cap: int, grid: Grid = Grid()
) -> DataFrame:
    """``(rep, other, sim, rk)``: top ``cap`` other groups of each group."""
    if floor <= 0:
        raise ValueError("the similarity floor must be positive")
    members, _ = self_units(groups.table.select("rep", "vec"), groups.groups, floor, grid)
    pairs = members.groupBy("cell", "a", "b").applyInArrow(_top_pairs(floor, cap, both_ways=True), _PAIRS)
    return keep_top(pairs, "rep", "other", cap)


def _expanded_lists(groups: Groups, pairs: DataFrame, cap: int) -> DataFrame:
    """``(rep, near)``: per group the top ``cap`` rows of other groups, in rank order."""
    ids = groups.table.select(F.col("rep").alias("other"), F.explode("ids").alias("j"))
    rows = keep_top(
        pairs.select("rep", "other", "sim").join(ids, "other").select("rep", "j", "sim"),
        "rep", "j", cap,
    )
    packed = F.array_sort(F.collect_list(F.struct("rk", "j", "sim")))  # at most cap entries
    return rows.groupBy("rep").agg(packed.alias("near"))


def _row_edges(rows: DataFrame, cap: int) -> DataFrame:
    """Edges of rows ``(i, ids, near)``: own copies first (cosine 1), then other groups."""
    own = F.transform(
        F.filter("ids", lambda j: j != F.col("i")),
        lambda j: F.struct(j.alias("j"), F.lit(1.0).alias("sim")),
    )
    near = F.transform(
        F.coalesce("near", F.array().cast("array<struct<rk:int,j:bigint,sim:double>>")),
        lambda e: F.struct(e["j"].alias("j"), e["sim"].alias("sim")),
    )
    best = F.slice(F.concat(own, near), 1, cap)
    return rows.select("i", F.posexplode(best).alias("_pos", "_e")).select(
        "i",
        F.col("_e.j").alias("j"),
        F.col("_e.sim").alias("sim"),
        (F.col("_pos") + 1).cast("int").alias("rk"),
    )


def head_edges(groups: Groups, floor: float, cap: int, grid: Grid = Grid()) -> DataFrame:
    """Neighbour edges ``(i, j, sim, rk)`` of the rows named in the groups' id lists."""
    pairs = group_neighbours(groups, floor, cap, grid)
    if not groups.has_copies:
        return pairs.select(F.col("rep").alias("i"), F.col("other").alias("j"), "sim", "rk")
    lists = groups.table.select("rep", "ids").join(
        _expanded_lists(groups, pairs, cap), "rep", "left"
    )
    return _row_edges(lists.select(F.explode("ids").alias("i"), "ids", "near"), cap)


def neighbours(
    units: DataFrame,
    floor: float = settings.SIMILARITY_FLOOR,
    cap: int = settings.NEIGHBOUR_CAP,
    grid: Grid = Grid(),
) -> DataFrame:
    """``(i, j, sim, rk)``: up to ``cap`` other rows with cosine at or above ``floor``.

    ``units`` is ``(id, vec)`` from :func:`pool`. Identical vectors are neighbours of
    each other; only the row itself is excluded. Ties go to the smaller id.
    """
    groups = group_copies(units, cap + 1)
    if not groups.has_followers:
        return head_edges(groups, floor, cap, grid)
    pairs = group_neighbours(groups, floor, cap, grid)
    lists = groups.table.join(_expanded_lists(groups, pairs, cap), "rep", "left")
    # The list side has one row per vector; a hot vector is split on the row side (AQE skew join).
    rows = with_vector_key(units).join(with_vector_key(lists), ["_vh", "vec"])
    return _row_edges(rows.select(F.col("id").alias("i"), "ids", "near"), cap)


# --- search from a second set ---------------------------------------------------------


def hashed(units: DataFrame, *columns: str) -> DataFrame:
    """Unit vectors written once, with a hash that tells which ones can be identical."""
    return as_table(units.select(F.col("id").alias("rep"), *columns, F.xxhash64("vec").alias("vh")), "units")


def top_rows(members: DataFrame, groups: DataFrame, floor: float, k: int, exclude: str = "own") -> DataFrame:
    """``(i, j, sim, rk)``: for each query of the units its ``k`` nearest rows of ``groups``.

    The homes of the units are vectors with the smallest ids that hold them, ``groups (rep, ids)``, ``k + 1`` of
    them unless there are fewer. A query's own id, or with ``later`` every id from its own on, is no match.
    """
    # A group shows at least one row unless its only one is the query itself.
    pairs = members.groupBy("cell", "a", "b").applyInArrow(
        _top_pairs(floor, k + 1, both_ways=False, exclude="later" if exclude == "later" else ""), _PAIRS
    )
    near = keep_top(pairs, "rep", "other", k + 1).drop("rk")
    rows = near.join(groups.select(F.col("rep").alias("other"), F.explode("ids").alias("j")), "other")
    allowed = F.col("j") < F.col("rep") if exclude == "later" else F.col("j") != F.col("rep")
    return keep_top(rows.filter(allowed).select("rep", "j", "sim"), "rep", "j", k).select(F.col("rep").alias("i"), "j", "sim", "rk")


def _grouped_search(queries: DataFrame, base: DataFrame, floor: float, k: int, grid: Grid, exclude: str) -> DataFrame:
    groups = group_copies(base, k + 1)
    distinct = groups.table.withColumn("vh", F.xxhash64("vec")).select("rep", "vec", "vh")
    cells = build_cells(distinct, groups.groups, dimension(distinct), grid)
    members, _ = query_units(cells, hashed(queries, "vec"), floor, grid)
    return top_rows(members, groups.table, floor, k, exclude)


def search(
    queries: DataFrame,
    base: DataFrame,
    floor: float,
    k: int,
    grid: Grid = Grid(),
) -> DataFrame:
    """``(i, j, sim, rk)``: for each query row the ``k`` nearest base rows above the floor.

    Both inputs are ``(id, vec)``; a base row with the query's own id is not a match. Identical
    vectors have a cosine of exactly one and come first, as in :func:`neighbours`; a vector that very
    many base rows share is compared once.
    """
    return _grouped_search(queries, base, floor, k, grid, "own")


def preceding(units: DataFrame, floor: float, k: int, grid: Grid = Grid()) -> DataFrame:
    """``(i, j, sim, rk)``: for each row the ``k`` nearest of the rows with smaller ids."""
    return _grouped_search(units, units, floor, k, grid, "later")


# Places looked at together where scopes are compared.
_PLACES = 2_000_000


def _scope_entries(left: list, right: list):
    """``(row, name)`` entries of ``left``, and the lists of the rows of ``right`` by name, for names on both; their number."""
    sides = []
    for scopes in (left, right):
        rows = np.repeat(np.arange(len(scopes)), [len(s) for s in scopes])
        sides.append((rows, np.array([c for s in scopes for c in s], dtype=object)))
    common = sorted(set(sides[0][1]) & set(sides[1][1]))
    number = {c: n for n, c in enumerate(common)}
    out = []
    for rows, names in sides:
        codes = np.array([number.get(c, -1) for c in names], dtype=np.int64)
        out.append((rows[codes >= 0], codes[codes >= 0]))
    rows, codes = out[1]
    order = np.argsort(codes, kind="stable")
    return out[0], (np.searchsorted(codes[order], np.arange(len(common) + 1)), rows[order]), len(common)


def _sharing(rows, cols, names: int, part: slice, width: int) -> np.ndarray:
    """Which of the rows ``part`` share a name with which column, from the list of columns of each name."""
    shared = np.zeros((part.stop - part.start, width), dtype=bool)
    row, name = rows
    mine = (row >= part.start) & (row < part.stop)
    row, name = row[mine] - part.start, name[mine]
    starts, listed = cols
    sizes = starts[name + 1] - starts[name]
    ends = np.cumsum(sizes)
    # Some entries at a time, so that memory does not follow names that very many rows have.
    for held in np.split(np.arange(len(row)), np.flatnonzero(np.diff(ends // _PLACES)) + 1):
        n = sizes[held]
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[name[held]], n)
        shared[np.repeat(row[held], n), listed[places]] = True
    return shared


def scoped_search(queries: DataFrame, base: DataFrame, floor: float, k: int, grid: Grid = Grid()) -> DataFrame:
    """``(i, j, sim, rk)``: for each query row the ``k`` nearest base rows that share a name with it.

    Both inputs are ``(id, vec, scope)`` with ``scope`` an array of names. The scope is tested in the unit, before
    the cut, so a query gets ``k`` rows wherever so many share a name with it above the floor. A base row with
    the query's own id is not a match; ties go to the smaller id.
    """
    b = hashed(base, "vec", "scope")
    q = b if queries is base else hashed(queries, "vec", "scope")
    cells = fitting_cells(q, b, floor, grid)
    members, _ = query_units(cells, q, floor, grid, ("vh", "scope"))
    pairs = members.groupBy("cell", "a", "b").applyInArrow(_top_pairs(floor, k, both_ways=False, scoped=True), _PAIRS)
    return keep_top(pairs, "rep", "other", k).select(F.col("rep").alias("i"), F.col("other").alias("j"), "sim", "rk")


def _counted(rows: _Side, cols: _Side, levels: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Per level, matches and matches with a shared name of every row, and the same of every column; an id is no match of itself."""
    by_row, by_col = np.zeros((len(levels), 2, len(rows)), np.int64), np.zeros((len(levels), 2, len(cols)), np.int64)
    mine, theirs, names = _scope_entries(rows.scopes, cols.scopes)
    # Sums by products; a part has fewer entries than a float can count.
    ones = np.ones(len(cols), np.float32)
    for part in _chunks(len(rows), len(cols)):
        sims = _cosines(rows, cols, part)
        sims[rows.ids[part][:, None] == cols.ids[None, :]] = -2.0
        shared = _sharing(mine, theirs, names, part, len(cols))
        for k, t in enumerate(levels):
            hit = sims >= t
            for which, some in enumerate((hit, hit & shared)):
                some = some.astype(np.float32)
                by_row[k, which, part] = some @ ones
                by_col[k, which] += (np.ones(len(some), np.float32) @ some).astype(np.int64)
    return by_row, by_col


def threshold_counts(
    queries: DataFrame,
    base: DataFrame,
    thresholds: tuple[float, ...],
    grid: Grid = Grid(),
) -> DataFrame:
    """``(id, threshold, n, n_scoped)``: base rows at or above each threshold per query row.

    Inputs are ``(id, vec, scope)`` where ``scope`` is an array of component names;
    ``n_scoped`` counts the matches that share a component. Counts are summed inside
    each unit, which returns a row only for query rows with a match in it. Where the base
    is the queries, two rows meet once and one product counts for both. Cells are made
    only where the lowest threshold lets their bounds prune.
    """
    levels, alike = sorted(thresholds), queries is base
    b = hashed(base, "vec", "scope")
    q = b if alike else hashed(queries, "vec", "scope")
    cells = fitting_cells(q, b, levels[0], grid)
    members, _ = self_members(cells, b, levels[0], grid) if alike else query_units(cells, q, levels[0], grid, ("vh", "scope"))

    def kernel(table: pa.Table) -> pa.Table:
        left, right = _sides(table)
        right = left if right is None else right
        out = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(left) and len(right):
            found = _counted(right, left, levels)
            for side, counts in zip((right, left), found if alike and right is not left else found[:1]):
                for t, (hits, scoped) in zip(levels, counts):
                    some = hits > 0
                    out.append((side.ids[some], np.full(some.sum(), t), hits[some], scoped[some]))
        ids, level, n, scoped = (np.concatenate(x) for x in zip(*out))
        return pa.table({"id": ids, "threshold": level, "n": n, "n_scoped": scoped})

    partial = members.groupBy("cell", "a", "b").applyInArrow(
        kernel, "id bigint, threshold double, n bigint, n_scoped bigint"
    )
    grid_rows = q.select(
        F.col("rep").alias("id"), F.explode(F.array(*[F.lit(t) for t in levels])).alias("threshold")
    )
    zeros = grid_rows.withColumn("n", F.lit(0)).withColumn("n_scoped", F.lit(0))
    return (
        partial.unionByName(zeros)
        .groupBy("id", "threshold")
        .agg(F.sum("n").alias("n"), F.sum("n_scoped").alias("n_scoped"))
    )


# --- linkage edges ---------------------------------------------------------------------


def _star_edges(floor: float):
    def kernel(table: pa.Table) -> pa.Table:
        left, right = _sides(table)
        none = pa.table({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        if not len(left) or (right is not None and not len(right)):
            return none
        lv, rv = left.vecs, left.vecs if right is None else right.vecs
        ids = left.ids if right is None else np.concatenate((left.ids, right.ids))
        offset = 0 if right is None else len(left)
        n = len(ids)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)

        def tied(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            """Smallest rank reachable over these links, spread until stable."""
            low = rank.copy()
            while True:
                before = low.copy()
                np.minimum.at(low, r, before[c])
                np.minimum.at(low, c, before[r])
                if np.array_equal(before, low):
                    return low

        # A part's links shrink to one per row before the next part is looked at.
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for part in _chunks(len(lv), len(rv)):
            r, c = np.nonzero(lv[part] @ rv.T >= floor)
            low = tied(r + part.start, c + offset)
            moved = np.flatnonzero(low != rank)
            kept.append((moved, order[low[moved]]))
        low = tied(*(np.concatenate(x) for x in zip(*kept))) if kept else rank
        linked = low != rank
        return pa.table({"u": ids[linked], "v": ids[order[low[linked]]]})

    return kernel


def linkage_edges(groups: Groups, floor: float, grid: Grid = Grid()) -> DataFrame:
    """Edges ``(u, v)`` over group representatives with the same connected components as
    the full graph of pairs at or above the floor, at most one per row and unit."""
    members, _ = self_units(groups.table.select("rep", "vec"), groups.groups, floor, grid)
    return members.groupBy("cell", "a", "b").applyInArrow(_star_edges(floor), "u bigint, v bigint").distinct()


def spanning(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the edges of a spanning forest of the greatest similarities, the ids, and the smallest id in the tree of each."""
    ids, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    order = np.argsort(-sim, kind="stable")
    a, b = ends[: len(u)][order], ends[len(u) :][order]
    n, live, chosen, tree = len(ids), np.arange(len(u)), [np.zeros(0, np.int64)], np.arange(len(ids))
    while True:
        x, y = tree[a[live]], tree[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            break
        # The first edge out of every tree, in the order of similarity.
        first = np.full(n, len(u))
        np.minimum.at(first, x, live)
        np.minimum.at(first, y, live)
        out = np.flatnonzero(first < len(u))
        taken = first[out]
        chosen.append(np.unique(taken))
        follows = np.arange(n)
        follows[out] = tree[a[taken]] + tree[b[taken]] - out
        # Two that follow each other: the smaller one stays.
        stays = out[(follows[follows[out]] == out) & (out < follows[out])]
        follows[stays] = stays
        while not np.array_equal(follows, follows[follows]):
            follows = follows[follows]
        tree = follows[tree]
    low = np.full(n, n)
    np.minimum.at(low, tree, np.arange(n))
    return order[np.concatenate(chosen)], ids, ids[low[tree]]


def _tree_edges(floor: float):
    def kernel(table: pa.Table) -> pa.Table:
        left, right = _sides(table)
        cols = left if right is None else right
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

        def reduced() -> tuple[np.ndarray, ...]:
            edges = tuple(np.concatenate(x) for x in zip(*held))
            kept = spanning(*edges)[0]
            return tuple(x[kept] for x in edges)

        pairs = 0
        for part in _chunks(len(left), len(cols)) if len(cols) else ():
            sims = left.vecs[part] @ cols.vecs.T
            r, c = np.nonzero(sims >= floor)
            if right is None:
                upper = c > r + part.start
                r, c = r[upper], c[upper]
            held.append((left.ids[part][r], cols.ids[c], sims[r, c]))
            pairs += len(r)
            if pairs >= _HELD:
                held, pairs = [reduced()], 0
        u, v, sim = reduced()
        return pa.table({"u": u, "v": v, "sim": sim})

    return kernel


def forest_edges(groups: Groups, floor: float, grid: Grid = Grid()) -> DataFrame:
    """Edges ``(u, v, sim)`` that have, at every level from the floor on, the connected components of all pairs."""
    members, _ = self_units(groups.table.select("rep", "vec"), groups.groups, floor, grid)
    return members.groupBy("cell", "a", "b").applyInArrow(_tree_edges(floor), "u bigint, v bigint, sim double")

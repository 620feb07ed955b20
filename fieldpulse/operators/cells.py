"""Cells of unit vectors on two levels, whose number follows the number of rows.

A few coarse pivots, chosen far apart, divide the space; inside each coarse cell a fixed share of its rows,
chosen far apart among four times as many, are the pivots of cells. Coarse pivots number at most the square root of the cells and travel to tasks;
cells are a table ``(coarse, cell, pivot, radius, rows)`` that meets the rows of its coarse cell only.
A row visits a cell if a partner within the floor can live there: its radius and the half-space border
between pivots both have to allow it. Cells that are small against the whole set share a lot: a row is sent
once to a lot, however many of its cells it visits, so what moves does not follow the number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from fieldpulse.runtime import as_table

# Slack for rounding in the pruning bound; the similarity test itself is exact.
_SLACK = 1e-6
# Vectors looked at for each pivot, and at most in one group of candidates.
_OVER, _CANDIDATES = 4, 4_096


@dataclass(frozen=True)
class Grid:
    """Bounds of the block join, in rows or bytes, none of them on the number of cells.

    ``max_coarse`` and ``coarse_bytes`` bound the pivots that tasks receive, ``block_rows`` and ``block_bytes`` a side
    of a unit, ``part_bytes`` the rows of a coarse cell that meet its cells in one group. Cells share a lot up to
    one in ``lots`` of all rows. Rows without cells are dealt to ``blocks`` blocks.
    """

    rows_per_cell: int = 4_096
    max_coarse: int = 1_024
    coarse_bytes: int = 8 << 20
    block_rows: int = 65_536
    block_bytes: int = 32 << 20
    part_bytes: int = 32 << 20
    max_partitions: int = 20_000
    lots: int = 16
    blocks: int = 12

    def rows_in_block(self, dim: int) -> int:
        return max(1, min(self.block_rows, self.block_bytes // (8 * max(1, dim))))

    def rows_in_lot(self, n: int, dim: int) -> int:
        """Rows of a lot, and of a side of a unit, among ``n`` rows: they follow ``n`` up to the bounds of a block."""
        return min(self.rows_in_block(dim), max(self.rows_per_cell, -(-n // self.lots)))

    def rows_in_side(self, n: int, dim: int) -> int:
        """Rows of a side of a unit where ``n`` rows have no cells: the blocks are as many at any ``n`` up to their bounds."""
        return min(self.rows_in_block(dim), max(1, -(-n // self.blocks)))

    def rows_in_part(self, dim: int) -> int:
        return max(1, self.part_bytes // (8 * max(1, dim)))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as lines, without Python objects."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _lines(n: int, width: int) -> Iterator[slice]:
    step = max(1, 2_000_000 // max(1, width))
    for start in range(0, n, step):
        yield slice(start, min(n, start + step))


@dataclass(frozen=True)
class Reach:
    """How far a partner within a floor can be: as an angle and as a chord."""

    turn: float
    chord: float

    @staticmethod
    def of(floor: float) -> Reach:
        return Reach(
            float(np.arccos(min(1.0, max(-1.0, floor)))) + _SLACK, float(np.sqrt(max(0.0, 2.0 - 2.0 * floor))) + _SLACK
        )

    def allows(self, x: np.ndarray, pivots: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """Lines of ``x`` by pivots: whether a partner may live in the pivot's cell.

        Rows live with the nearest of ``pivots``. No partner lives in a cell whose pivot is further than the reach
        and the cell's radius, nor beyond a half-space border that is further away than the chord.
        """
        near_as = np.clip(x @ pivots.T, -1.0, 1.0)
        near, each = near_as.argmax(axis=1), np.arange(len(x))
        squares = 2.0 - 2.0 * near_as
        gaps = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (pivots @ pivots.T)))
        with np.errstate(divide="ignore", invalid="ignore"):
            border = (squares - squares[each, near][:, None]) / (2.0 * gaps[near])
        # Coinciding pivots give NaN, which must not prune.
        # An arc of at most the reach and the radius, told by its cosine; cells without rows have a radius of minus infinity.
        arc = self.turn + radii
        least = np.where(arc >= np.pi, -1.0, np.where(arc < 0.0, np.inf, np.cos(np.clip(arc, 0.0, np.pi))))
        return (near_as >= least[None, :]) & ~(border > self.chord)


def _with(schema: StructType, *fields: tuple[str, object]) -> StructType:
    added = {name for name, _ in fields}
    return StructType([f for f in schema if f.name not in added] + [StructField(n, t) for n, t in fields])


def _append(table, schema_names: list[str], **columns):
    """``table`` with the added columns, as a batch or a table, in the order of the schema."""
    for name, values in columns.items():
        if name in table.schema.names:
            table = table.drop_columns([name])
        table = table.append_column(name, values)
    return table.select(schema_names)


def _far_apart(sample: np.ndarray, count: int) -> list[int]:
    """Lines of ``count`` vectors of the sample, each the furthest from those before it."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        # Equal vectors may all be as near as can be; none is taken twice.
        nearest[chosen] = np.inf
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return chosen


def _coarse_pivots(rows: DataFrame, count: int) -> np.ndarray:
    """``count`` vectors far apart out of four times as many by hash; both are bounded by the grid, and reruns agree."""
    taken = rows.select("vec", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(_OVER * count)
    sample = np.array([r["vec"] for r in taken.collect()], dtype=np.float64)
    return sample[_far_apart(sample, count)]


def _fine_pivots(placed: DataFrame, grid: Grid) -> DataFrame:
    """``(coarse, cell, pivot)``: one row in ``grid.rows_per_cell``, far apart among the candidates of its coarse cell.

    Candidates come in parts of bounded size, so a crowded coarse cell is more groups, not a larger one.
    """
    over = min(_OVER, grid.rows_per_cell)
    hashed = placed.withColumn("_h", F.xxhash64(F.lit("cell"), F.col("rep")))
    taken = as_table(hashed.filter(F.pmod("_h", F.lit(grid.rows_per_cell)) < over).select("coarse", "rep", "vec", "_h"), "cells-candidates")
    parts = taken.groupBy("coarse").agg(F.ceil(F.count("*") / _CANDIDATES).alias("_parts"))
    dealt = taken.join(F.broadcast(parts), "coarse").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col("rep")), F.col("_parts")))

    def choose(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["_h"].to_numpy(), kind="stable")))
        lines = _far_apart(matrix(table["vec"]), -(-table.num_rows // over))
        return table.take(pa.array(lines)).select(["coarse", "rep", "vec"]).rename_columns(["coarse", "cell", "pivot"])

    return dealt.drop("_parts").groupBy("coarse", "part").applyInArrow(choose, "coarse int, cell bigint, pivot array<double>")


def to_coarse(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with the number of their nearest coarse pivot and the angle to it."""
    schema = _with(rows.schema, ("coarse", IntegerType()), ("angle", DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coarse, angle = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            if batch.num_rows:
                x = matrix(batch.column("vec"))
                for part in _lines(len(x), len(pivots)):
                    found = angles(x[part], pivots)
                    coarse[part] = found.argmin(axis=1)
                    angle[part] = found.min(axis=1)
            yield _append(batch, schema.names, coarse=pa.array(coarse), angle=pa.array(angle))

    return rows.mapInArrow(run, schema)


def _meet(rows: DataFrame, cells: DataFrame, counts: DataFrame, part_rows: int, run, schema: StructType, by: str = "coarse") -> DataFrame:
    """``run(rows, cells)`` for the rows and the cells of each coarse cell or pack, in parts of about ``part_rows`` rows.

    ``counts`` is ``(coarse, n)``, at most one row per coarse pivot; a crowded coarse cell is more groups, not a larger one.
    """
    parts = F.broadcast(counts.select(by, F.greatest(F.ceil(F.col("n") / part_rows), F.lit(1)).cast("int").alias("_parts")))
    left = rows.join(parts, by).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col("rep")), F.col("_parts")).cast("int"))
    right = cells.join(parts, by).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return left.drop("_parts").groupBy(by, "part").cogroup(right.drop("_parts").groupBy(by, "part")).applyInArrow(run, schema)


def into_cells(rows: DataFrame, cells: DataFrame, part_rows: int) -> DataFrame:
    """Rows ``(rep, vec, coarse, ...)`` with the nearest cell of their coarse cell and the angle to its pivot."""
    schema = _with(rows.schema, ("cell", LongType()), ("angle", DoubleType()))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, pivots = right["cell"].to_numpy(), matrix(right["pivot"])
        order = np.argsort(names)
        names, pivots = names[order], pivots[order]
        cell, angle = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows)
        x = matrix(left["vec"]) if left.num_rows else np.zeros((0, pivots.shape[1]))
        for part in _lines(len(x), len(pivots)):
            found = angles(x[part], pivots)
            cell[part] = names[found.argmin(axis=1)]
            angle[part] = found.min(axis=1)
        return _append(left, schema.names, cell=pa.array(cell), angle=pa.array(angle))

    counts = rows.groupBy("coarse").agg(F.count("*").alias("n"))
    return _meet(rows, cells.select("coarse", "cell", "pivot"), counts, part_rows, run, schema)


@dataclass(frozen=True)
class Cells:
    """``pivots`` and ``radii`` of the coarse cells, ``table`` of the cells, ``homes``: the rows with ``coarse`` and ``cell``.

    ``single`` is the number of rows if one cell holds them all, so that there is no bound to test. ``lots`` is None as
    long as every cell stands for itself; see :func:`in_lots`.
    """

    pivots: np.ndarray
    radii: np.ndarray
    table: DataFrame
    homes: DataFrame
    single: int | None = None
    lots: Lots | None = None


@dataclass(frozen=True)
class Lots:
    """``side``: rows of a lot; ``packs``: the pack of each coarse cell; ``several``: whether a pack has more than one lot.

    A pack is coarse cells that share one lot, or one crowded coarse cell with lots of its own.
    """

    side: int
    packs: np.ndarray
    several: np.ndarray


def in_lots(cells: Cells, dim: int, grid: Grid) -> Cells:
    """``cells`` with the number of its lot in place of each cell, in ``table`` and ``homes``.

    Coarse cells that together have no more rows than a lot share one. The cells of a crowded one are dealt to as many lots
    as its rows ask for, by a hash of their names, so the lot of a row follows from its coarse cell and its cell alone.
    """
    if cells.single is not None:
        return cells
    held = np.zeros(len(cells.pivots), np.int64)
    # One row per coarse pivot, at most `Grid.max_coarse`.
    for r in cells.table.groupBy("coarse").agg(F.sum("rows").alias("n")).collect():
        held[r["coarse"]] = r["n"]
    side = grid.rows_in_lot(int(held.sum()), dim)
    first, dealt, packs, several, lots, room = [], [], [], [], 0, -1
    for rows in map(int, held):
        parts = max(1, -(-rows // side))
        if rows > room:
            several.append(parts > 1)
            lots, room = lots + parts, side if parts == 1 else 0
        # A coarse cell that still finds room is in the newest lot.
        first.append(lots - parts)
        dealt.append(parts)
        packs.append(len(several) - 1)
        room -= rows if parts == 1 else 0
    at = F.col("coarse") + 1
    spread = F.pmod(F.xxhash64(F.lit("lot"), F.col("cell")), F.element_at(F.lit(dealt), at))
    lot = (F.element_at(F.lit(first), at) + spread).cast("bigint")
    return replace(
        cells, table=cells.table.withColumn("cell", lot), homes=cells.homes.withColumn("cell", lot),
        lots=Lots(side, np.array(packs), np.array(several)),
    )


def coarse_radii(placed: DataFrame, count: int) -> np.ndarray:
    """Largest angle between each coarse pivot and a row of its cell; minus infinity for an empty cell."""
    radii = np.full(count, -np.inf)
    # One row per coarse pivot, at most `Grid.max_coarse`.
    for r in placed.groupBy("coarse").agg(F.max("angle").alias("radius")).collect():
        radii[r["coarse"]] = r["radius"]
    return radii


def one_cell(base: DataFrame, n: int, dim: int) -> Cells:
    """All ``n`` rows in one cell, where every row is visited by every row."""
    one = base.sparkSession.range(1).select(
        F.lit(0).alias("coarse"), F.lit(0).cast("bigint").alias("cell"), F.lit(None).cast("array<double>").alias("pivot"),
        F.lit(float(np.pi)).alias("radius"), F.lit(n).cast("bigint").alias("rows"),
    )
    homes = base.withColumns({"coarse": F.lit(0), "cell": F.lit(0).cast("bigint")})
    return Cells(np.zeros((1, dim)), np.full(1, np.pi), one, homes, single=n)


def build_cells(base: DataFrame, n: int, dim: int, grid: Grid, to_keep: bool = False) -> Cells:
    """Cells of about ``grid.rows_per_cell`` of the rows ``(rep, vec, ...)``; ``n`` is their number.

    Cells ``to_keep`` for rows that come later include those without a row yet.
    """
    spark = base.sparkSession
    wanted = -(-n // grid.rows_per_cell)
    if wanted <= 1 and not to_keep:
        return one_cell(base, n, dim)
    count = max(1, min(grid.max_coarse, grid.coarse_bytes // (8 * max(1, dim)), int(np.ceil(np.sqrt(wanted)))))
    pivots = _coarse_pivots(base, count) if n else np.zeros((1, dim))
    placed = as_table(to_coarse(base, pivots), "cells-coarse")
    # The coarse pivots are cells too, so that no coarse cell is without one; their names are below all ids.
    own = spark.createDataFrame(
        [(k, -(1 << 62) + k, [float(x) for x in p]) for k, p in enumerate(pivots)], "coarse int, cell bigint, pivot array<double>"
    )
    fine = as_table(_fine_pivots(placed, grid).union(own), "cells-pivots")
    homes = as_table(into_cells(placed, fine, grid.rows_in_part(dim)), "cells-homes")
    bounds = homes.groupBy("coarse", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("rows"))
    table = fine.join(bounds, ["coarse", "cell"], "left" if to_keep else "inner")
    table = as_table(table.withColumns({"radius": F.coalesce("radius", F.lit(float("-inf"))), "rows": F.coalesce("rows", F.lit(0))}), "cells-table")
    return Cells(pivots, coarse_radii(placed, len(pivots)), table, homes)


# Rows of a cell on which the bounds are tried.
_TRIED = 128


def bounds_prune(queries: DataFrame, base: DataFrame, floor: float, dim: int, grid: Grid) -> bool:
    """Whether cells are worth their making: a row visits fewer than half of the lots.

    Told by some rows in cells of about ``_TRIED``, as many as all rows have. Their radii are rather too small than too
    large, so bounds that do not prune here do not prune among all rows either. Results never depend on it.
    """
    share = max(1, grid.rows_per_cell // _TRIED)
    some = F.pmod(F.xxhash64(F.lit("tried"), F.col("rep")), F.lit(share)) == 0
    tried = as_table(base.filter(some).select("rep", "vec"), "cells-tried")
    asking = tried if queries is base else as_table(queries.filter(some).select("rep", "vec"), "cells-asking")
    few = replace(grid, rows_per_cell=grid.rows_per_cell // share)
    cells = in_lots(build_cells(tried, tried.count(), dim, few), dim, few)
    if cells.single is not None:
        return False
    met = visits(asking, cells, floor, dim, few, upward_only=False).agg(F.sum(F.size("cells"))).first()[0] or 0
    return 2 * met <= asking.count() * cells.table.select("cell").distinct().count()


def visits(rows: DataFrame, cells: Cells, floor: float, dim: int, grid: Grid, upward_only: bool) -> DataFrame:
    """Rows ``(rep, vec, ...)`` with ``cells``: the names of the cells, or lots, where a partner within the floor may live.

    With ``upward_only`` a row that lives in ``cell`` lists higher names only, so that two cells of one set meet
    once. Rows without a cell to visit drop. Written once, as lists; a row may come with several lists, which
    have no name in common.
    """
    if cells.single is not None:
        return rows.withColumn("cells", F.array().cast("array<bigint>") if upward_only else F.array(F.lit(0).cast("bigint")))
    reach, (pivots, radii), lots = Reach.of(floor), (cells.pivots, cells.radii), cells.lots
    packs = np.arange(len(pivots)) if lots is None else lots.packs
    several = np.ones(len(pivots), bool) if lots is None else lots.several
    # Lots are numbered from pack to pack, names of cells are not.
    from_own = upward_only and lots is not None
    kept = rows.select(*[c for c in rows.columns if c not in ("angle", *(() if from_own else ("coarse",)))])
    listed = _with(StructType([f for f in kept.schema if f.name != "coarse"]), ("packs", ArrayType(IntegerType())))

    def lists(allowed: np.ndarray, names: np.ndarray) -> pa.ListArray:
        at, which = np.nonzero(allowed)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(allowed)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(names[which]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, starts = np.unique(packs, return_index=True)
        for batch in batches:
            x = matrix(batch.column("vec")) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            own = packs[batch.column("coarse").to_numpy()] if from_own and batch.num_rows else None
            for part in _lines(len(x), len(pivots)):
                some = batch.slice(part.start, part.stop - part.start)
                allowed = np.logical_or.reduceat(reach.allows(x[part], pivots, radii), starts, axis=1)
                if own is not None:
                    mine = own[part][:, None]
                    allowed &= (numbers[None, :] > mine) | (several[None, :] & (numbers[None, :] == mine))
                yield _append(some, listed.names, packs=lists(allowed, numbers.astype(np.int32)))

    sent = as_table(kept.mapInArrow(spread, listed), "cells-sent")
    exploded = sent.withColumn("pack", F.explode("packs")).drop("packs")
    counts = exploded.groupBy("pack").agg(F.count("*").alias("n"))
    schema = _with(StructType([f for f in exploded.schema if f.name not in ("pack", "cell")]), ("cells", ArrayType(LongType())))

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            # Cells by coarse cell, as the border between two pivots counts only where both are of one.
            order = np.lexsort((right["cell"].to_numpy(), right["coarse"].to_numpy()))
            coarse, names, bounds = (right[c].to_numpy()[order] for c in ("coarse", "cell", "radius"))
            fine, x = matrix(right["pivot"])[order], matrix(left["vec"])
            targets = np.unique(names)
            inside, starts = np.unique(coarse, return_index=True)
            for part in _lines(len(x), max(len(fine), len(pivots))):
                wide = reach.allows(x[part], pivots, radii)
                allowed = np.zeros((part.stop - part.start, len(targets)), bool)
                for number, start, stop in zip(inside, starts, [*starts[1:], len(coarse)]):
                    near = np.flatnonzero(wide[:, number])
                    if len(near):
                        hit = reach.allows(x[part][near], fine[start:stop], bounds[start:stop])
                        mine, firsts = np.unique(names[start:stop], return_index=True)
                        at = np.searchsorted(targets, mine)
                        allowed[near[:, None], at[None, :]] |= np.logical_or.reduceat(hit, firsts, axis=1)
                if upward_only:
                    allowed &= targets[None, :] > left["cell"].to_numpy()[part][:, None]
                some = left.slice(part.start, part.stop - part.start)
                held = allowed.any(axis=1)
                found.append(_append(some.filter(pa.array(held)), schema.names, cells=lists(allowed[held], targets)))
        none = _append(left.slice(0, 0), schema.names, cells=pa.array([], pa.list_(pa.int64())))
        return pa.concat_tables([none, *found])

    pack = F.element_at(F.lit([int(p) for p in packs]), F.col("coarse") + 1).cast("int")
    by_pack = cells.table.select(pack.alias("pack"), "coarse", "cell", "pivot", "radius")
    return as_table(_meet(exploded, by_pack, counts, grid.rows_in_part(dim), choose, schema, "pack"), "cells-visits")

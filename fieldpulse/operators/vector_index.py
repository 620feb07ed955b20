"""A stored index of unit vectors: rows by coarse cell, pivots and radii beside them.

Below the root lie

* ``rows/batch=N/coarse=C``: one row per distinct vector of a batch with its smallest ids, sorted by cell;
* ``cells/version=N``: pivot, radius and number of rows of every cell after batch ``N``;
* ``coarse/version=N``: pivots and radii of the coarse cells after batch ``N``;
* ``_published/N``: an empty marker, made after everything else of batch ``N`` is there.

Readers take the newest published version and the batches up to it, so a batch shows whole or not at
all, and what a failed append left is written over by its rerun. Pivots never change: a search reads
the coarse cells that its queries' bounds allow, and an append touches no file of an earlier batch.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.operators.cells import Cells, Grid, build_cells, coarse_radii, in_lots, into_cells, to_coarse, visits
from fieldpulse.operators.neighbours import dimension, group_copies, hashed, query_members, top_rows
from fieldpulse.runtime import as_table, hadoop_path, published, publish

_ROWS = "rep bigint, vec array<double>, vh bigint, ids array<bigint>, cell bigint, batch int, coarse int"
_CELLS = "coarse int, cell bigint, pivot array<double>, radius double, rows bigint"
_COARSE = "coarse int, pivot array<double>, radius double"


class VectorIndex:
    """Units ``(id, vec)`` under ``root``; see :func:`fieldpulse.operators.neighbours.pool`.

    ``keep`` is the number of smallest ids stored of each vector of a batch; searches return up to ``keep - 1`` rows.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int, grid: Grid = Grid()):
        self.spark, self.root, self.keep, self.grid = spark, root, keep, grid

    # --- reading ---------------------------------------------------------------------

    def version(self) -> int:
        there = published(self.spark, self.root)
        if not there:
            raise ValueError(f"no published index under {self.root}")
        return there[-1]

    def _cells(self, version: int) -> Cells:
        table = self.spark.read.schema(_CELLS).parquet(f"{self.root}/cells/version={version}")
        # One row per coarse pivot, at most `Grid.max_coarse`.
        coarse = self.spark.read.schema(_COARSE).parquet(f"{self.root}/coarse/version={version}").orderBy("coarse").collect()
        pivots = np.array([r["pivot"] for r in coarse], dtype=np.float64)
        return Cells(pivots, np.array([r["radius"] for r in coarse]), table, self.rows(version))

    def rows(self, version: int) -> DataFrame:
        path = f"{self.root}/rows"
        return self.spark.read.schema(_ROWS).parquet(path).filter(F.col("batch") <= version)

    def allowed_rows(self, came: DataFrame, version: int, table: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """The stored rows of the cells, or lots, in the lists ``came.cells``; other coarse cells are not opened."""
        asked = as_table(came.select(F.explode("cells").alias("cell")).distinct().join(table.select("cell", "coarse"), "cell"), "index-asked")
        # At most `Grid.max_coarse` numbers, so that partitions are pruned before the scan is planned.
        opened = [r["coarse"] for r in asked.select("coarse").distinct().collect()]
        rows = self.rows(version) if rows is None else rows
        return rows.filter(F.col("coarse").isin(opened)).join(asked.select("cell"), "cell", "left_semi")

    def search(self, queries: DataFrame, floor: float, k: int) -> DataFrame:
        """``(i, j, sim, rk)``: for each query row its ``k`` nearest stored rows above the floor, exactly."""
        if k >= self.keep:
            raise ValueError(f"the index keeps {self.keep} ids of a vector, too few for k = {k}")
        version = self.version()
        cells = self._cells(version)
        cells = in_lots(cells, cells.pivots.shape[1], self.grid)
        asked = hashed(queries, "vec")
        came = visits(asked, cells, floor, cells.pivots.shape[1], self.grid, upward_only=False)
        homes = self.allowed_rows(came, version, cells.table, cells.homes)
        members, _ = query_members(replace(cells, homes=homes), came, cells.pivots.shape[1], self.grid)
        return top_rows(members, homes, floor, k)

    # --- writing ---------------------------------------------------------------------

    def create(self, units: DataFrame) -> VectorIndex:
        """Batch 0: chooses the pivots. A later :meth:`create` under another root is how an index is laid out anew."""
        if published(self.spark, self.root):
            raise ValueError(f"an index is published under {self.root} already")
        groups = group_copies(units, self.keep)
        table = groups.table.withColumn("vh", F.xxhash64("vec"))
        cells = build_cells(table, groups.groups, dimension(table), self.grid, to_keep=True)
        radii = cells.radii
        self._write(0, cells.homes, cells.table, cells.pivots, radii)
        return self

    def append(self, units: DataFrame) -> VectorIndex:
        """One more batch; ids must be new. Cells keep their pivots, and their radii grow where the batch asks for it."""
        version = self.version()
        cells = self._cells(version)
        table = group_copies(units, self.keep).table.withColumn("vh", F.xxhash64("vec"))
        placed = as_table(to_coarse(table, cells.pivots), "index-coarse")
        homes = as_table(into_cells(placed, cells.table, self.grid.rows_in_part(cells.pivots.shape[1])), "index-homes")
        grown = homes.groupBy("cell").agg(F.max("angle").alias("_radius"), F.count("*").alias("_rows"))
        bounds = cells.table.join(grown, "cell", "left").select(
            "coarse", "cell", "pivot", F.greatest("radius", "_radius").alias("radius"),
            (F.col("rows") + F.coalesce("_rows", F.lit(0))).alias("rows"),
        )
        radii = np.maximum(cells.radii, coarse_radii(placed, len(cells.pivots)))
        self._write(version + 1, homes, bounds, cells.pivots, radii)
        return self

    def _write(self, version: int, homes: DataFrame, table: DataFrame, pivots: np.ndarray, radii: np.ndarray) -> None:
        rows = homes.select("rep", "vec", "vh", "ids", "cell", "coarse").repartition("coarse", F.pmod("cell", F.lit(8)))
        rows.sortWithinPartitions("coarse", "cell").write.mode("overwrite").partitionBy("coarse").parquet(f"{self.root}/rows/batch={version}")
        if not homes.take(1):
            # A batch without rows is a folder all the same.
            fs, at = hadoop_path(self.spark, f"{self.root}/rows/batch={version}")
            fs.mkdirs(at)
        table.write.mode("overwrite").parquet(f"{self.root}/cells/version={version}")
        coarse = [(k, [float(x) for x in p], float(r)) for k, (p, r) in enumerate(zip(pivots, radii))]
        self.spark.createDataFrame(coarse, _COARSE).write.mode("overwrite").parquet(f"{self.root}/coarse/version={version}")
        publish(self.spark, self.root, version)

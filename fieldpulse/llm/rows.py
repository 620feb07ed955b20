"""Small helpers shared by the operators: text normal forms, checked broadcasts, row filters."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Cells of 8 to 16 bytes in memory: a broadcast table stays in the tens of megabytes.
BROADCAST_CELLS = 4_000_000
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
# Name under which a worker process keeps things from task to task.
MEMORY = "_fieldpulse_worker_memory"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; plain ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def map_texts(rows: DataFrame, run: Callable[[Iterator], Iterator], schema: str | StructType,
              remembers: bool = False) -> DataFrame:
    """``mapInArrow`` over rows that hold whole texts, in bounded memory.

    Batches are bounded in bytes (:data:`BATCH_BYTES` unless the session has a bound of its own), so neither side of the exchange holds more than a few megabytes of
    texts, however long they are; a text above the bound is a batch of its own. Worker processes
    outlive their tasks: unless ``run`` itself ``remembers``, what an earlier step left in
    :data:`MEMORY` is dropped first, and freed memory goes back to the system afterwards.
    """
    def bounded(batches: Iterator) -> Iterator:
        import ctypes
        import sys

        import pyarrow as pa

        if not remembers:
            sys.modules.pop(MEMORY, None)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # a C library without it keeps the memory for its next use

    conf = rows.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return rows.mapInArrow(bounded, schema)


def narrow(df: DataFrame, cells: Column | int, max_cells: int = BROADCAST_CELLS) -> tuple[DataFrame, bool]:
    """``df`` marked for broadcast if it was measured to be small, and whether it was.

    ``cells`` is the size of a row in words of 8 bytes; an expression where rows hold arrays.
    """
    size = df.agg(F.sum(F.lit(cells) if isinstance(cells, int) else cells)).first()[0] or 0
    return (F.broadcast(df), True) if size <= max_cells else (df, False)


def drop_ids(docs: DataFrame, losers: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in the one-column table ``losers``; all columns stay.

    A counted, small ``losers`` is broadcast; a larger one is the build side of a hash join, so
    texts move once and are never sorted.
    """
    ids = losers.toDF("_loser").distinct()
    side, small = narrow(ids, 1)
    side = side if small else side.hint("shuffle_hash")
    return docs.join(side, docs[id_col].eqNullSafe(side["_loser"]), "left_anti")

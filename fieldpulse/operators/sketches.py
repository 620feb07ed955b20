"""Distinct counts that grow: mergeable sketches kept per group and merged as rows arrive.

A theta sketch keeps up to ``2 ** lg_k`` of the smallest hashes. It counts exactly up to that many values, and
beyond with a relative error of about ``1 / sqrt(2 ** lg_k)``. Sketches of different rows merge to the sketch of
all of them, in any order and with repeats, so nothing is counted again; they also meet, which tells how many
values two groups share. The group's rows are counted beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.operators.buckets import BucketTable

LG_K = 14
FIELDS = "n bigint, seen binary"


def sketched(rows: DataFrame, keys: Iterable[str], value: str | Column, lg_k: int = LG_K) -> DataFrame:
    """``(*keys, n, seen)``: the rows of each group and the sketch of its values; null values are not counted.

    The sketch combines before the shuffle, so a hot group sends one sketch per task.
    """
    column = F.col(value) if isinstance(value, str) else value
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.theta_sketch_agg(column, lg_k).alias("seen"))


def merged(sketches: DataFrame, keys: Iterable[str], lg_k: int = LG_K) -> DataFrame:
    """Groups of ``(…, n, seen)`` rows as one row each; ``keys`` may be fewer than the rows have, to roll up."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.theta_union_agg("seen", lg_k).alias("seen"))


def distinct(seen: str = "seen") -> Column:
    return F.theta_sketch_estimate(seen)


def shared(one: str | Column, other: str | Column) -> Column:
    """How many values two sketches have in common; 0 where one of them is missing."""
    return F.coalesce(F.theta_sketch_estimate(F.theta_intersection(one, other)), F.lit(0).cast("bigint"))


def sketch_sink(table: BucketTable, keys: Iterable[str], value: str | Column, lg_k: int = LG_K,
                first: int = 0) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: micro-batch ``n`` is merge ``first + n`` of ``table``, whose rows are ``(*keys, n, seen)``.

    Only buckets with arriving groups are read and written. A replayed micro-batch finds its merge published, so
    its rows are not counted twice.
    """
    keys = list(keys)

    def write(batch: DataFrame, epoch: int) -> None:
        arrived = sketched(batch, keys, value, lg_k)
        table.merge(arrived, lambda current, new: merged(current.unionByName(new), keys, lg_k), first + epoch)

    return write

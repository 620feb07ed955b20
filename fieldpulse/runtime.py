"""Session helpers shared by every job: durable lineage cuts and dense ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    left it unset (as in tests) gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="fieldpulse-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a cache or a local checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """``(file system, path)`` of a folder in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop_path(spark, path)
    return fs.exists(at)


def published(spark: SparkSession, root: str) -> list[int]:
    """Versions under ``root`` whose marker is there, from the names of the markers; no table file is opened."""
    fs, at = hadoop_path(spark, f"{root}/_published")
    if not fs.exists(at):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at))


def publish(spark: SparkSession, root: str, version: int) -> None:
    """Make the marker of a version in one step; fails if it is there already."""
    fs, marker = hadoop_path(spark, f"{root}/_published/{version}")
    fs.create(marker, False).close()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder and all below it; one that is not there is no error."""
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application cut and wrote to its own folder below the shared one.

    For the end of a job: tables from :func:`as_table` are read up to then.
    """
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        drop_path(spark, folder)


_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """While it lasts, what an execution shuffled is deleted as it ends, not when the driver collects its garbage.

    For jobs of many large executions. A DataFrame made here and executed twice shuffles again.
    """
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)


def as_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write once to the shared folder, or to ``path``, and read back.

    Used where several later steps want different columns of one result: the
    columnar copy keeps column pruning and real size statistics.
    """
    path = scratch_path(df.sparkSession, name) if path is None else path
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_ids(df: DataFrame, order: str, name: str) -> DataFrame:
    """Number rows 1..n by ``order`` without pulling them into one task.

    Rows are range-partitioned, numbered inside their range, and shifted by the
    row count of the lower ranges. Only one count per range is ever gathered.
    """
    ranged = cut(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row per range, at most `spark.sql.shuffle.partitions`, so this window is bounded.
    offsets = counts.select(
        "_range",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
    )
    local = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(name, (local + F.col("_offset")).cast("bigint"))
        .drop("_range", "_offset")
    )


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give a CPU-heavy step on a bare scan as many tasks as the session has cores.

    A scan with enough splits, as any large table has, is returned as it is.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= wanted:
        return scan
    return scan.repartition(wanted, *keys)


def first_true(*branches: tuple[Column, str]) -> Column:
    """Label of the first branch that holds, NULL when none does."""
    chain = F.when(F.coalesce(branches[0][0], F.lit(False)), branches[0][1])
    for condition, label in branches[1:]:
        chain = chain.when(F.coalesce(condition, F.lit(False)), label)
    return chain

"""Versioned parquet snapshots of the operational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldpulse.runtime import hadoop_path, publish, published
from fieldpulse.schema import TABLES, conform


def save_snapshot(df: DataFrame, root: str, name: str, version: int, keep: int | None = None) -> str:
    """Write one version of a table from the executors, then publish it by an empty marker file.

    Readers see a version only with its marker, which is made in one step after all files are
    there; what a failed run left without a marker is replaced. A published version is never
    replaced. ``keep`` drops all but that many newest versions, markers first.
    """
    spark = df.sparkSession
    path = f"{root}/{name}/version={version}"
    if version in published(spark, f"{root}/{name}"):
        raise ValueError(f"version {version} of {name} is published already")
    conform(df, name).write.mode("overwrite").parquet(path)
    publish(spark, f"{root}/{name}", version)
    for old in published(spark, f"{root}/{name}")[: -keep] if keep else ():
        for gone in (f"_published/{old}", f"version={old}"):
            fs, at = hadoop_path(spark, f"{root}/{name}/{gone}")
            fs.delete(at, True)
    return path


def load_snapshot(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """One published version of a table, the newest by default."""
    there = published(spark, f"{root}/{name}")
    chosen = max(there, default=None) if version is None else version
    if chosen not in there:
        raise ValueError(f"{name} has no published version" + (f" {version}" if version is not None else ""))
    return spark.read.schema(TABLES[name].schema).parquet(f"{root}/{name}/version={chosen}")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], partitions: int, **options: str) -> DataFrame:
    """Table scan of an operational database, split on a numeric key."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=key,
            lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, **options,
        )
        .load()
    )

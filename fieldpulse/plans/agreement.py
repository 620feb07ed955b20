"""Feeds stored in key buckets with an order-free digest of each, to compare two of them where they differ.

Below the root lie ``rows/bucket=B`` and ``digests``, one row for each bucket. Rows without a key are in bucket
-1. A digest does not depend on the order of rows or files, so two deliveries of the same rows have equal ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpulse.plans.profile import feed_tallies, match_rates

KEYLESS = -1


@dataclass(frozen=True)
class Feed:
    """A stored feed; ``columns`` are compared, ``key`` is matched."""

    spark: SparkSession
    root: str
    schema: T.StructType
    key: str
    columns: tuple[str, ...]
    buckets: int

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; the files of others are not opened."""
        stored = self.spark.read.schema(self.schema).parquet(f"{self.root}/rows")
        return stored if buckets is None else stored.filter(F.col("bucket").isin(buckets))

    def digests(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/digests")


def _marks(columns: list[str]) -> list[Column]:
    """Two hashes of a row. A hash passes over nulls, so it is told which columns are null."""
    told = [p for c in columns for p in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(seed), *told).cast("decimal(20,0)") for seed in (1, 2)]


def store(df: DataFrame, root: str, key: str, columns: list[str], buckets: int = 1_024) -> Feed:
    """Write ``key`` and ``columns`` of ``df`` by bucket, then the digests of what was written.

    Rows are dealt to files by adaptive rebalancing, so that a bucket with a key held by very many rows is cut
    into several files. The digests are of the rows read back: hashes are summed by bucket alone, so that only the
    counts of a key are held by key, and those are dealt by key, not a bucket to a task.
    """
    if buckets < 1:
        raise ValueError("at least one bucket")
    bucket = F.when(F.col(key).isNull(), KEYLESS).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")
    placed = df.select(key, *columns, bucket.alias("bucket")).hint("rebalance", F.col("bucket"))
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/rows")
    feed = Feed(df.sparkSession, root, placed.schema, key, tuple(columns), buckets)
    first, second = _marks([key, *columns])
    sums = feed.rows().groupBy("bucket").agg(F.sum(first).alias("first"), F.sum(second).alias("second"))
    by_key = feed.rows().groupBy("bucket", key).agg(F.count("*").alias("rows"))
    counts = by_key.groupBy("bucket").agg(F.count("*").alias("keys"), F.max("rows").alias("most"))
    counts.join(sums, "bucket").coalesce(1).write.mode("overwrite").parquet(f"{root}/digests")
    return feed


def settled_and_open(left: Feed, right: Feed) -> tuple[int, list[int]]:
    """The keys of all buckets that agree by their digests, and the buckets whose rows have to be compared.

    A bucket with a repeated or missing key is always compared, since its rows meet more than one row, or none.
    At most ``buckets + 1`` rows reach the driver.
    """
    if (left.key, left.columns, left.buckets) != (right.key, right.columns, right.buckets):
        raise ValueError("feeds are compared on the same key, columns and buckets")
    parts = ("keys", "most", "first", "second")
    told = [f.digests().select("bucket", F.struct(*parts).alias(n)) for f, n in ((left, "a"), (right, "b"))]
    agree = (F.col("bucket") != KEYLESS) & F.col("a").eqNullSafe(F.col("b")) & (F.col("a.most") == 1)
    both = told[0].join(told[1], "bucket", "full_outer").select("bucket", "a.keys", F.coalesce(agree, F.lit(False)).alias("agree"))
    found = both.collect()
    return sum(r["keys"] for r in found if r["agree"]), sorted(r["bucket"] for r in found if not r["agree"])


def agreement(left: Feed, right: Feed) -> DataFrame:
    """The row of :func:`fieldpulse.plans.profile.feed_agreement`, from the rows of differing buckets only.

    Feeds without rows give zeros. Two different buckets pass for equal with a chance of about 2^-120.
    """
    settled, differing = settled_and_open(left, right)
    columns = list(left.columns)
    counts = feed_tallies(left.rows(differing).drop("bucket"), right.rows(differing).drop("bucket"), left.key, columns)
    added = ["keys", "in_both", *(f"{c}_match" for c in columns)]
    whole = reduce(lambda df, c: df.withColumn(c, F.col(c) + F.lit(settled)), added, counts)
    return match_rates(whole, columns)

"""A keyed table in hash buckets behind a manifest: a merge rewrites only the buckets it touches.

Below the root lie ``data/version=N/bucket=B``, the rows of a bucket as merge ``N`` left them;
``manifest/version=N``, one row ``(bucket, version)`` for each bucket that has rows; and
``_published/N``, an empty marker made last. Readers follow the newest published manifest, so a merge
shows whole or not at all. A merge that failed half-way is written over by its rerun; one that is
published already is not applied again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpulse.operators.merge import last_wins
from fieldpulse.runtime import as_table, drop_path, hadoop_path, publish, published, scratch_path

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class BucketTable:
    """Rows of ``schema``, unique on ``keys``, in ``buckets`` parts by a hash of the keys.

    The number of buckets is fixed for the table's life and bounds what the driver reads of a manifest.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Iterable[str], buckets: int = 64):
        if buckets < 1:
            raise ValueError("at least one bucket")
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root, schema, list(keys), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def version(self) -> int | None:
        return max(published(self.spark, self.root), default=None)

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """The version of each bucket that has rows."""
        version = self.version() if version is None else version
        if version is None:
            return {}
        rows = self.spark.read.schema("bucket int, version int").parquet(f"{self.root}/manifest/version={version}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.root}/data/version={version}/bucket={bucket}"

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows as a published merge left them, of all buckets or of some."""
        held = self.manifest(version)
        wanted = held if buckets is None else [b for b in buckets if b in held]
        paths = [self._folder(b, held[b]) for b in sorted(wanted)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; other buckets are not opened. At most ``buckets`` numbers reach the driver."""
        hit = [r[0] for r in keys.select(self._bucket()).distinct().collect()]
        return self.read(buckets=hit).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def merge(self, incoming: DataFrame, merge: Merge, version: int | None = None) -> list[int]:
        """Apply ``merge(current, incoming) -> next`` to the buckets that ``incoming`` has keys of; returns these.

        ``next`` may change, add and drop rows of those buckets only. ``version`` names the merge, by default
        the next one; one that is published already changes nothing and returns no bucket. Arrivals are stored
        for the merge and deleted after it.
        """
        before = self.version()
        version = (0 if before is None else before + 1) if version is None else version
        if before is not None and version <= before:
            return []
        arrivals = scratch_path(self.spark, "arrivals")
        try:
            return self._merged(as_table(incoming.withColumn("_bucket", self._bucket()), "arrivals", arrivals), merge, before, version)
        finally:
            drop_path(self.spark, arrivals)

    def _merged(self, rows: DataFrame, merge: Merge, before: int | None, version: int) -> list[int]:
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())
        held = self.manifest(before) if before is not None else {}
        if touched:
            after = merge(self.read(before, touched), rows.drop("_bucket"))
            typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
            strayed = F.raise_error(F.lit("a merge returned a row of a bucket that it did not touch"))
            placed = after.select(*typed).withColumn("bucket", self._bucket())
            checked = placed.withColumn("bucket", F.when(F.col("bucket").isin(touched), F.col("bucket")).otherwise(strayed.cast("int")))
            target = f"{self.root}/data/version={version}"
            # Dealt by adaptive rebalancing, so that a large bucket is several files of bounded size, not one task.
            checked.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(target)
            fs, at = hadoop_path(self.spark, target)
            written = {int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(at) if f.isDirectory()}
            held = {b: v for b, v in held.items() if b not in touched} | dict.fromkeys(written, version)
        self.spark.createDataFrame(sorted(held.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/manifest/version={version}"
        )
        publish(self.spark, self.root, version)
        return touched

    def upsert_sink(
        self, merge: Merge, order: Iterable[str], first: int = 0, keep: int | None = None
    ) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: micro-batch ``n``, reduced to the last sighting of each key, is merge ``first + n``.

        ``first`` is the number of merges before the stream began, the same in all its runs. ``order`` tells
        sightings of one micro-batch apart; between micro-batches the later one arrives later. A replayed
        micro-batch finds its merge published and changes nothing. With ``keep``, versions older than the ``keep``
        newest ones go after each merge; without it all stay.
        """
        order = list(order)

        def write(batch: DataFrame, epoch: int) -> None:
            self.merge(last_wins(batch, self.keys, order), merge, first + epoch)
            if keep is not None:
                self.drop_unused(keep)

        return write

    def drop_unused(self, keep: int = 1) -> int:
        """Delete what none of the ``keep`` newest manifests names, markers first; returns the folders deleted."""
        there = published(self.spark, self.root)
        newest, old = there[-keep:], there[:-keep]
        used = {(v, b) for n in newest for b, v in self.manifest(n).items()}
        fs, _ = hadoop_path(self.spark, self.root)
        for n in old:
            for name in (f"_published/{n}", f"manifest/version={n}"):
                fs.delete(hadoop_path(self.spark, f"{self.root}/{name}")[1], True)
        gone = 0
        for version in range(newest[-1] + 1 if newest else 0):
            _, at = hadoop_path(self.spark, f"{self.root}/data/version={version}")
            if not fs.exists(at):
                continue
            for f in fs.listStatus(at):
                name = f.getPath().getName()
                if name.startswith("bucket=") and (version, int(name.partition("=")[2])) not in used:
                    gone += fs.delete(f.getPath(), True)
        return gone

"""Incremental arrival with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fieldpulse.operators.merge import last_wins
from fieldpulse.operators.normalise import normalise_reports
from fieldpulse.runtime import as_table
from fieldpulse.sources.landed import LANDING, REPORT_RECORD, open_envelope


def landing_stream(
    spark: SparkSession, path: str, schema, files: str = "*", fmt: str = "parquet", per_batch: int | None = None
) -> DataFrame:
    """Stream over a landing folder; ``per_batch`` bounds the files of one micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", files)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(path)


def run_available(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process everything that has arrived, then stop; progress lives in ``checkpoint``."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()
    return query


def epoch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Append each micro-batch under its own ``epoch=``; a replayed batch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def counting_sink(
    sink: Callable[[DataFrame, int], None], path: str, reason: str = "reject_reason"
) -> Callable[[DataFrame, int], None]:
    """Pass the rows without a ``reason`` on and count all others by it under ``epoch=`` of ``path``.

    Accepted rows are counted under a NULL reason. The micro-batch is read once; a replayed one
    replaces its counts.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = as_table(batch, "batch")
        counts = rows.groupBy(reason).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        sink(rows.filter(F.col(reason).isNull()).drop(reason), epoch)

    return write


def late_rows(query: StreamingQuery) -> int:
    """What came behind the watermark of a finished run and was dropped by its stateful steps.

    Counted as it reaches such a step: single rows for :func:`filed_once`, but for windowed counts the
    partial counts of a task, so there it tells that rows were late, and at least how many.
    """
    return sum(
        state.numRowsDroppedByWatermark for p in query.recentProgress for state in p.stateOperators
    )


def release(rows: DataFrame, filed: str, as_of: Column, holdback_days: int) -> tuple[DataFrame, DataFrame]:
    """``(ready, held)``: rows filed at least ``holdback_days`` before ``as_of``, and those that wait on.

    Recent filings are incomplete; a later run releases what it held, so no row is lost or doubled.
    Rows without a filing date are ready.
    """
    waits = F.coalesce(F.datediff(as_of, F.col(filed)) < holdback_days, F.lit(False))
    return rows.filter(~waits), rows.filter(waits)


def report_stream(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """Normalised complaint rows of landed responses, rejects included, as they arrive.

    ``landed_seq`` and ``rec_ord`` tell in which order the records of a micro-batch were delivered.
    """
    reader = spark.readStream.schema(LANDING)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    records = open_envelope(reader.json(path), REPORT_RECORD, "make", "query_model", "model_year", "landed_seq")
    return normalise_reports(records.withColumnRenamed("model_year", "query_year"))


def filed_once(stream: DataFrame, key: str, filed: str, delay: str) -> DataFrame:
    """First sighting of each key within the filing watermark; older state is dropped."""
    return stream.withWatermark(filed, delay).dropDuplicatesWithinWatermark([key])


def counts_over_time(
    stream: DataFrame, at: str, keys: list[str], width: str, slide: str | None = None, delay: str = "1 day"
) -> DataFrame:
    """Arrivals per key and event-time window, tumbling or sliding."""
    span = F.window(at, width, slide) if slide else F.window(at, width)
    return (
        stream.withWatermark(at, delay)
        .groupBy(span.alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")
    )


def latest_epoch(df: DataFrame, keys: list[str]) -> DataFrame:
    """The newest value per key from rows appended by update-mode micro-batches."""
    return last_wins(df, keys, ["epoch"]).drop("epoch")


def lateness(reports: DataFrame, incident: str, filed: str, holdback_days: int, *by: str) -> DataFrame:
    """Reports per group whose filing trails the incident by more than the holdback."""
    lag = F.datediff(filed, incident)
    return reports.groupBy(*by).agg(
        F.count("*").alias("reports"),
        F.count_if(lag > holdback_days).alias("late"),
        F.max(lag).alias("max_lag_days"),
    )


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, change)`` between two snapshots: added, removed or changed."""
    a = before.select(key, F.struct(*columns).alias("a"))
    b = after.select(key, F.struct(*columns).alias("b"))
    change = (
        F.when(F.col("a").isNull(), "added")
        .when(F.col("b").isNull(), "removed")
        .when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter(
        F.col("change").isNotNull()
    )


_CHANGE = "change string, old string, new string, at timestamp, seq bigint"


def state_changes(stream: DataFrame, key: str, columns: list[str], at: str, seq: str, gone: str | None = None) -> DataFrame:
    """``(key, change, old, new, at, seq)``: one event for every real change of ``columns`` of a key.

    The stream delivers sightings of a key, told apart by ``(at, seq)``. The first one is ``added``; a sighting that
    differs from the one before it is ``changed``; one whose column ``gone`` is true is ``removed``, after
    which the key may be added again. A sighting that is not newer than the last one seen, as in a delivery
    that comes twice, is no event. ``old`` and ``new`` are JSON texts of the columns. State is one row per key.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    key_type = stream.schema[key].dataType.simpleString()
    held = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = stream.select(
        F.col(key), held.alias("now"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(seq).cast("bigint").alias("seq"),
        F.coalesce(F.col(gone) if gone else F.lit(False), F.lit(False)).alias("gone"),
    )

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, last_us, last_seq = state.get if state.exists else (None, None, None)
        # Sightings of one key in one micro-batch; the trigger's limit bounds them.
        seen = pd.concat(list(batches)).sort_values(["us", "seq"], kind="stable")
        out = []
        for now, us, number, away in zip(seen["now"], seen["us"].tolist(), seen["seq"].tolist(), seen["gone"].tolist()):
            if last_us is not None and (us, number) <= (last_us, last_seq):
                continue
            now = None if away else now
            if now != last:
                kind = "added" if last is None else "removed" if now is None else "changed"
                out.append((keys[0], kind, last, now, pd.Timestamp(us, unit="us", tz="UTC").tz_convert(zone).tz_localize(None), number))
            last, last_us, last_seq = now, us, number
        state.update((last, last_us, last_seq))
        yield pd.DataFrame(out, columns=["key", "change", "old", "new", "at", "seq"])

    changed = rows.groupBy(key).applyInPandasWithState(
        step, f"key {key_type}, {_CHANGE}", "last string, us bigint, seq bigint", "append", GroupStateTimeout.NoTimeout
    )
    return changed.withColumnRenamed("key", key)


def hold_back(stream: DataFrame, key: str, filed: str, days: int, delay: str = "0 seconds", shards: int = 1) -> DataFrame:
    """Rows of the stream once their holdback is over, with ``release_at`` and ``late``.

    Recent filings are incomplete, so a row waits until the watermark of ``filed`` has passed its filing by ``days``;
    an event-time timer of its day of filing then releases it. A row that comes after its release time goes
    on at once and is marked ``late``, so late rows are counted one by one and none is dropped. Rows without a
    filing date are passed on as not late. What waits is state: it outlives a restart, and each row
    leaves it once. ``shards`` divides the rows of a day among so many groups.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    held = F.to_json(F.struct(*stream.columns), {"ignoreNullFields": "false"})
    # Spark drops rows behind the watermark ahead of state with timers. So a row travels without a time, and
    # its time beside it without the row: times move the watermark, and no row is dropped.
    time, nothing = F.col(filed).cast("timestamp"), F.lit(None)
    apart = F.explode(F.array(
        F.struct(time.alias("at"), nothing.cast("string").alias("row")), F.struct(nothing.cast("timestamp").alias("at"), held.alias("row"))
    ))
    rows = stream.select(
        apart.alias("_r"), F.to_date(time).alias("day"), F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"),
        F.unix_millis(F.date_add(F.to_date(time), days + 1).cast("timestamp")).alias("due"),
    ).select(F.col("_r.at").alias("at"), "day", "shard", "due", F.col("_r.row").alias("row")).withWatermark("at", delay)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            due, waiting = state.get
            state.remove()
            yield pd.DataFrame({"row": waiting, "due": due, "late": False})
            return
        for seen in batches:
            seen = seen[seen["row"].notna()]
            if not len(seen):
                continue
            if pd.isna(seen["due"].iloc[0]):
                yield pd.DataFrame({"row": seen["row"], "due": None, "late": False})
                continue
            due = int(seen["due"].iloc[0])
            if due < state.getCurrentWatermarkMs():
                yield pd.DataFrame({"row": seen["row"], "due": due, "late": True})
                continue
            state.update((due, [*(state.get[1] if state.exists else ()), *seen["row"]]))
            # Timers lie ahead of the watermark; one that is due at it fires with its next step.
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    released = rows.groupBy("day", "shard").applyInPandasWithState(
        step, "row string, due bigint, late boolean", "due bigint, waiting array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )
    opened = F.from_json("row", stream.schema)
    return released.select(opened.alias("r"), F.timestamp_millis("due").alias("release_at"), "late").select("r.*", "release_at", "late")

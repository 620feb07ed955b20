"""Table updates as functions ``(current, incoming) -> next`` on whole DataFrames.

Both sides are unique on the key, so every update is one equi-join without skew; repeated
deliveries are reduced with :func:`last_wins` first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.functions.text import is_failure_report, strip_boilerplate
from fieldpulse.runtime import dense_ids


def last_wins(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """The last sighting of each key.

    Ranks are limited to the first before the shuffle and after it, so a hot key leaves one row per
    task, and rows are never copied into an aggregate.
    """
    keys, order = list(keys), list(order)
    latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank").select(
        *keys, *[c for c in df.columns if c not in keys]
    )


def unique_rows(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``df``, failing when it is read if a key occurs twice.

    The count shares the partitioning and order that a join on the keys needs anyway.
    """
    keys = list(keys)
    repeated = F.count("*").over(Window.partitionBy(*keys)) > 1
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    named = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    message = F.concat(F.lit("more than one row for the key "), named)
    return df.withColumn("_twice", repeated & known).filter(
        F.when(F.col("_twice"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    ).drop("_twice")


def upsert(
    current: DataFrame,
    incoming: DataFrame,
    keys: Iterable[str],
    merge: dict[str, Callable[[Column, Column], Column]] | None = None,
    on_insert: dict[str, Column] | None = None,
) -> DataFrame:
    """Insert or update by key; the result has the columns of ``current``.

    An incoming column overwrites the stored one, a column that is not delivered is kept.
    ``merge[c](old, new)`` replaces the overwrite on conflict, ``on_insert[c]`` the inserted value.
    A key that is delivered twice fails the update instead of multiplying the stored row.
    """
    keys, merge, on_insert = list(keys), merge or {}, on_insert or {}
    old = current.select(F.struct(*current.columns).alias("o"), *keys)
    new = unique_rows(incoming, keys).select(F.struct(*incoming.columns).alias("n"), *keys)
    both = old.join(new, keys, "full_outer")
    o, n = F.col("o"), F.col("n")

    def column(c: str) -> Column:
        if c in keys:
            return F.col(c)
        kept = o[c]
        arriving = n[c] if c in incoming.columns else None
        if arriving is None and c not in merge and c not in on_insert:
            return kept.alias(c)
        if c in merge:
            updated = merge[c](o, n)
        else:
            updated = arriving if arriving is not None else kept
        inserted = on_insert.get(c, arriving if arriving is not None else F.lit(None))
        return (
            F.when(n.isNull(), kept).when(o.isNull(), inserted).otherwise(updated).alias(c)
        )

    return both.select(*[column(c) for c in current.columns])


def upsert_flat(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Delimited feed: every delivered column overwrites, components included."""
    rows = incoming.withColumn("source", F.lit("flat")).withColumn("ingested_at", now)
    return upsert(current, rows, ["odi_number"])


def upsert_api(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """API refresh: the coarse components never replace stored full components.

    A first insert leaves ``components`` NULL; stripped text and failure flag are kept.
    """
    rows = incoming.withColumn("source", F.lit("api")).withColumn("ingested_at", now)
    return upsert(
        current,
        rows,
        ["odi_number"],
        merge={"components": lambda o, n: F.coalesce(o["components"], n["components_coarse"])},
        on_insert={"components": F.lit(None).cast("array<string>")},
    )


RECALL_KEY = ("campaign_number", "make", "model", "model_year")


def upsert_recalls(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    return upsert(current, incoming.withColumn("ingested_at", now), RECALL_KEY)


def upsert_vector(
    current: DataFrame, incoming: DataFrame, column: str, model: str, now: Column
) -> DataFrame:
    """Vectors ``(odi_number, vector)`` into one vector column; the other one is kept."""
    rows = incoming.select(
        "odi_number", F.col("vector").alias(column), F.lit(model).alias("model"), now.alias("embedded_at")
    )
    return upsert(current, rows, ["odi_number"])


def upsert_recall_vectors(current: DataFrame, incoming: DataFrame, model: str, now: Column) -> DataFrame:
    rows = incoming.select(
        *RECALL_KEY, F.col("vector").alias("embedding"), F.lit(model).alias("model_name"),
        now.alias("embedded_at"),
    )
    return upsert(current, rows, RECALL_KEY)


def arrivals(current: DataFrame, incoming: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Incoming rows tagged ``arrival`` = inserted or refreshed."""
    keys = list(keys)
    known = current.select(*keys, F.lit(True).alias("_known"))
    return incoming.join(known, keys, "left").select(
        *incoming.columns,
        F.when(F.col("_known"), "refreshed").otherwise("inserted").alias("arrival"),
    )


def apply_scores(patterns: DataFrame, scores: DataFrame, now: Column) -> DataFrame:
    """Write ``(id, recent_count, baseline_count, ratio, severity)`` onto the patterns."""
    return upsert(
        patterns,
        scores.select("id", "recent_count", "baseline_count", "ratio", "severity", now.alias("updated_at"))
        .join(patterns.select("id"), "id", "left_semi"),
        ["id"],
    )


def write_verdicts(
    patterns: DataFrame, verdicts: DataFrame, source: str, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(next patterns, history rows, unknown ids)`` from ``(id, verdict, recall_ref)``.

    A history row is written only when a stored verdict is replaced by a different one. Both
    outputs derive from the same input snapshot, so a replaced verdict is always recorded. Two verdicts
    for one id fail the write. History rows get their ids from :func:`append_history`.
    """
    answer = unique_rows(verdicts, ["id"]).select(
        "id", F.col("verdict").alias("_v"), F.col("recall_ref").alias("_r"), F.lit(True).alias("_hit")
    )
    joined = patterns.join(answer, "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    columns = {
        "novelty_verdict": F.when(hit, F.col("_v")).otherwise(F.col("novelty_verdict")),
        "novelty_recall_ref": F.when(hit, F.col("_r")).otherwise(F.col("novelty_recall_ref")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    updated = joined.select(*[columns.get(c, F.col(c)).alias(c) for c in patterns.columns])
    replaced = F.col("novelty_verdict").isNotNull() & ~(
        F.col("novelty_verdict").eqNullSafe(F.col("_v"))
        & F.col("novelty_recall_ref").eqNullSafe(F.col("_r"))
    )
    history = joined.filter(hit & replaced).select(
        F.col("id").alias("pattern_id"),
        F.col("novelty_verdict").alias("old_verdict"),
        F.col("novelty_recall_ref").alias("old_recall_ref"),
        F.col("_v").alias("new_verdict"),
        F.col("_r").alias("new_recall_ref"),
        F.lit(source).alias("source"),
        now.alias("changed_at"),
    )
    unknown = verdicts.join(patterns.select("id"), "id", "left_anti").select("id")
    return updated, history, unknown


def append_history(history: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored audit history with new rows after it, their ids counting on from the largest stored one."""
    numbered = dense_ids(rows, "pattern_id", "_n")
    top = history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")).withColumn("_one", F.lit(1))
    added = numbered.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one").withColumn(
        "id", F.col("_n") + F.col("_top")
    )
    return history.unionByName(added.select(*history.columns))


def apply_states(patterns: DataFrame, events: DataFrame) -> DataFrame:
    """Triage events ``(id, state, at, seq)``: the last event of a pattern sets its state."""
    last = events.groupBy("id").agg(
        F.max_by(F.struct("state", "at"), F.struct("at", "seq")).alias("_e")
    )
    joined = patterns.join(last, "id", "left")
    columns = {
        "state": F.coalesce("_e.state", "state"),
        "updated_at": F.coalesce("_e.at", "updated_at"),
    }
    return joined.select(*[columns.get(c, F.col(c)).alias(c) for c in patterns.columns])


def classify_missing(reports: DataFrame, **options) -> DataFrame:
    """Set the failure flag where it is NULL; classified rows are never revisited."""
    flag = F.col("is_failure_report")
    return reports.withColumn(
        "is_failure_report",
        F.when(flag.isNull(), is_failure_report(F.col("summary"), **options)).otherwise(flag),
    )


def fill_stripped(reports: DataFrame, **options) -> DataFrame:
    """Write the boilerplate-free text where it is missing; stored text is kept."""
    stripped = strip_boilerplate(F.col("summary"), **options)["text"]
    missing = F.col("summary_stripped").isNull() & F.col("summary").isNotNull()
    return reports.withColumn(
        "summary_stripped", F.when(missing, stripped).otherwise(F.col("summary_stripped"))
    )


def classification_counts(reports: DataFrame, **options) -> DataFrame:
    """One row: rows classified by a run over ``reports``, split by outcome."""
    todo = reports.filter(F.col("is_failure_report").isNull())
    hit = is_failure_report(F.col("summary"), **options)
    return todo.select(hit.alias("_f")).agg(
        F.count("*").alias("classified"),
        F.count_if("_f").alias("failure_report"),
        F.count_if(~F.col("_f")).alias("non_failure_report"),
    )


def missing_vectors(rows: DataFrame, vectors: DataFrame, keys: Iterable[str], column: str) -> DataFrame:
    """Rows without a stored non-NULL vector; these are the work left after an interrupted run."""
    keys = list(keys)
    return rows.join(vectors.filter(F.col(column).isNotNull()).select(*keys), keys, "left_anti")

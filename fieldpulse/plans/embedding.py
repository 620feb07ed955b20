"""Batch embedding through an injected function, resumable and bounded in concurrency."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpulse import settings
from fieldpulse.functions.text import clip, strip_ws
from fieldpulse.operators.merge import missing_vectors
from fieldpulse.runtime import scratch_path

Embedder = Callable[[list[str]], list[list[float]]]


# What an HTTP-like status asks for; a status that is not listed is final.
_WAIT, _RENEW, _STOP = "wait", "renew", "stop"


def retry_action(status: int | None) -> str:
    """Throttling and server faults pass by themselves, a rejected credential has to be renewed."""
    if status is None:
        return _STOP
    if status == 429 or status >= 500:
        return _WAIT
    return _RENEW if status in (401, 403) else _STOP


def with_retries(
    call: Embedder,
    attempts: int = settings.EMBED_ATTEMPTS,
    cap: float = settings.EMBED_BACKOFF_CAP,
    refresh: Callable[[], None] | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> Embedder:
    """``call`` with a budget of attempts; its exceptions may carry a ``status``.

    Pauses double from one second up to ``cap`` and are jittered, so that callers throttled together do
    not come back together. Without ``refresh`` a rejected credential is final.
    """

    def guarded(texts: list[str]) -> list[list[float]]:
        pause, spent = 1.0, 0
        while True:
            spent += 1
            try:
                return call(texts)
            except Exception as failure:
                action = retry_action(getattr(failure, "status", None))
                if action == _STOP or (action == _RENEW and refresh is None):
                    raise
                if spent == attempts:
                    raise RuntimeError(f"gave up on a batch of {len(texts)} texts, tried {spent} times") from failure
                if action == _RENEW:
                    refresh()
                else:
                    sleep(min(cap, pause + random.random()))
                    pause *= 2

    return guarded


def pending_texts(
    rows: DataFrame, vectors: DataFrame, keys: list[str], text: Column, column: str, only_missing: bool = True
) -> DataFrame:
    """``(*keys, text)`` to embed: rows with text and, by default, without a stored vector."""
    todo = rows.select(*keys, text.alias("text")).filter(F.col("text").isNotNull())
    return missing_vectors(todo, vectors, keys, column) if only_missing else todo


def recall_text() -> Column:
    """Summary and consequence; NULL only when both are."""
    joined = strip_ws(F.concat_ws(" ", "summary", "consequence"))
    return F.when(F.coalesce("summary", "consequence").isNotNull(), joined)


def embed(
    todo: DataFrame,
    keys: list[str],
    call: Embedder,
    partitions: int,
    batch: int = settings.EMBED_BATCH,
    chars: int | None = None,
) -> DataFrame:
    """``(*keys, vector)`` for ``(*keys, text)`` rows.

    ``partitions`` bounds concurrent callers, ``batch`` the texts per call. Texts are whole unless
    ``chars`` asks for a cut, as an embedder of limited input does. Vectors come back as rows;
    nothing is written from inside a task.
    """
    types = {f.name: f.dataType.simpleString() for f in todo.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["vector array<float>"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                out = part[keys].copy()
                out["vector"] = [list(map(float, v)) for v in call(part["text"].tolist())]
                yield out

    clipped = todo.select(*keys, clip(F.col("text"), chars).alias("text"))
    return clipped.repartition(partitions).mapInPandas(run, schema)


def embed_in_slices(
    todo: DataFrame, keys: list[str], call: Embedder, path: str, partitions: int, slices: int = 8, **options
) -> None:
    """Embed and append slice by slice, so an interrupted run loses at most one slice.

    The pending rows are worked out once and written by slice; each slice reads its own part. A rerun
    starts from :func:`pending_texts` against the rows already appended to ``path``.
    """
    spark = todo.sparkSession
    pending = scratch_path(spark, "pending")
    part = F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int")
    todo.withColumn("_slice", part).write.partitionBy("_slice").parquet(pending)
    schema = T.StructType([*todo.schema.fields, T.StructField("_slice", T.IntegerType())])
    every = spark.read.schema(schema).parquet(pending)
    for n in range(slices):
        mine = every.filter(F.col("_slice") == n).drop("_slice")
        embed(mine, keys, call, partitions, **options).write.mode("append").parquet(path)


def embedding_report(todo: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """One row: texts to embed, those with a vector now, vectors written, and their dimension.

    ``written`` counts the stored rows themselves and ``dim`` is the size of the stored vectors,
    NULL if they have none or differ.
    """
    have = stored.filter(F.col("vector").isNotNull()).select(*keys, F.size("vector").alias("_size"))
    none = F.lit(None).cast("int").alias("_size")
    rows = (
        todo.select(F.lit("asked").alias("_kind"), none)
        .unionByName(todo.join(have, keys, "left_semi").select(F.lit("met").alias("_kind"), none))
        .unionByName(have.select(F.lit("stored").alias("_kind"), "_size"))
    )
    return rows.agg(
        F.count_if(F.col("_kind") == "asked").alias("to_embed"),
        F.count_if(F.col("_kind") == "met").alias("embedded"),
        F.count_if(F.col("_kind") == "stored").alias("written"),
        F.when(F.min("_size") == F.max("_size"), F.min("_size")).alias("dim"),
    )

"""Pattern formation: pool, growth, minimum size, ids, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpulse import settings
from fieldpulse.functions.labels import vehicle
from fieldpulse.operators.cluster import (
    BLOCK_ROWS,
    formation_report,
    grow,
    keep_large,
    number_patterns,
)
from fieldpulse.operators.neighbours import Grid, pool
from fieldpulse.runtime import as_table


def member_facts(
    members: DataFrame, reports: DataFrame, *kinds: str
) -> DataFrame:
    """Most frequent vehicle, category and component per pattern, from one pass over its members.

    ``kinds`` picks the facts. For each the result has its value, ``<kind>_n`` (rows with it) and
    ``<kind>_kinds`` (distinct values); ties go to the smallest value. A missing list of coarse
    components counts as uncategorised, an empty one for nothing. Both aggregates combine
    before their shuffle, so no pattern is ever gathered or sorted in one task.
    """
    needs = {
        "vehicle": ("make", "model"), "category": ("components_coarse",), "component": ("components",)
    }
    labels = {
        "vehicle": lambda: F.array(vehicle(F.col("make"), F.col("model"))),
        "category": lambda: F.coalesce("components_coarse", F.array(F.lit(settings.NO_CATEGORY))),
        "component": lambda: F.coalesce("components", F.array().cast("array<string>")),
    }
    columns = [c for k in kinds for c in needs[k]]
    rows = members.select("pattern_id", "odi_number").join(
        reports.select("odi_number", *columns), "odi_number"
    )

    def tagged(k: str) -> Column:
        return F.transform(labels[k](), lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value")))

    counts = (
        rows.select("pattern_id", F.explode(F.concat(*[tagged(k) for k in kinds])).alias("_l"))
        .groupBy("pattern_id", "_l")
        .agg(F.count("*").alias("_n"))
    )

    def facts(k: str) -> list[Column]:
        mine = F.col("_l.kind") == k
        top = F.min(F.when(mine, F.struct((-F.col("_n")).alias("neg"), F.col("_l.value").alias("value"))))
        return [top.alias(f"_{k}"), F.count_if(mine).alias(f"{k}_kinds")]

    best = counts.groupBy("pattern_id").agg(*[c for k in kinds for c in facts(k)])
    return best.select(
        "pattern_id",
        *[
            c
            for k in kinds
            for c in (
                F.col(f"_{k}.value").alias(k), (-F.col(f"_{k}.neg")).alias(f"{k}_n"), F.col(f"{k}_kinds")
            )
        ],
    )


def formation_pool(reports: DataFrame, embeddings: DataFrame, vector: str = "embedding_stripped") -> DataFrame:
    """``(id, vec)`` of failure reports with a vector; an unclassified report is left out."""
    chosen = reports.filter(F.col("is_failure_report")).select("odi_number")
    vectors = embeddings.filter(F.col(vector).isNotNull()).select("odi_number", vector)
    return pool(vectors.join(chosen, "odi_number"), "odi_number", vector)


def pattern_name(members: Column) -> Column:
    """Display name from :func:`member_facts`: dominant vehicle, other vehicles, component."""
    others = F.when(F.col("vehicle_n") == members, F.lit("")).otherwise(
        F.concat(F.lit(" +"), (F.col("vehicle_kinds") - 1).cast("string"), F.lit(" other"))
    )
    return F.concat(
        "vehicle", others, F.lit(" — "), F.coalesce("component", F.lit("uncategorised"))
    )


def provisional_names(members: DataFrame, sizes: DataFrame, reports: DataFrame) -> DataFrame:
    """``(pattern_id, name)`` from the members' vehicles and full components."""
    return (
        member_facts(members, reports, "vehicle", "component")
        .join(sizes, "pattern_id")
        .select("pattern_id", pattern_name(F.col("member_count")).alias("name"))
    )


def form_members(
    units: DataFrame,
    floor: float = settings.SIMILARITY_FLOOR,
    cap: int = settings.NEIGHBOUR_CAP,
    min_members: int = settings.MIN_PATTERN_MEMBERS,
    grid: Grid = Grid(),
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, sizes, report)`` of a formation from scratch.

    ``members`` is ``(pattern_id, odi_number, similarity)``, ``sizes`` is
    ``(pattern_id, member_count)``; ids follow the founding rows.
    """
    assigned = as_table(grow(units, floor, cap, grid, block_rows), "assigned")
    kept = as_table(number_patterns(keep_large(assigned, min_members)), "kept")
    members = assigned.join(kept.select("cluster", "pattern_id"), "cluster").select(
        "pattern_id", F.col("i").alias("odi_number"), F.col("join_sim").alias("similarity")
    )
    return members, kept.select("pattern_id", "member_count"), formation_report(assigned, min_members)


def form_patterns(
    reports: DataFrame,
    embeddings: DataFrame,
    now: Column,
    floor: float = settings.SIMILARITY_FLOOR,
    cap: int = settings.NEIGHBOUR_CAP,
    min_members: int = settings.MIN_PATTERN_MEMBERS,
    vector: str = "embedding_stripped",
    grid: Grid = Grid(),
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Replacement ``(patterns, members, report)``; None for an empty pool, so that the
    caller keeps the stored patterns."""
    # Written once: tested for rows, then read by every step of the formation.
    units = as_table(formation_pool(reports, embeddings, vector), "pool")
    if units.isEmpty():
        return None
    members, sizes, report = form_members(units, floor, cap, min_members, grid, block_rows)
    named = sizes.join(provisional_names(members, sizes, reports), "pattern_id")
    patterns = named.select(
        F.col("pattern_id").alias("id"),
        "name",
        F.col("member_count").cast(T.IntegerType()).alias("member_count"),
        F.lit(0).alias("recent_count"),
        F.lit(0).alias("baseline_count"),
        F.lit(None).cast("double").alias("ratio"),
        F.lit(None).cast("string").alias("severity"),
        F.lit(settings.STATES[0]).alias("state"),
        F.lit(None).cast("string").alias("novelty_verdict"),
        F.lit(None).cast("string").alias("novelty_recall_ref"),
        now.alias("first_seen_at"),
        now.alias("updated_at"),
    )
    return patterns, members, report

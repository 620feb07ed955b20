"""Corpus profiles and retrieval experiments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.text import any_of


def value_shares(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Count and share of rows per value; an array column counts each of its values."""
    is_array = df.select(column.alias("v")).schema["v"].dataType.typeName() == "array"
    rows = df.select((F.explode(column) if is_array else column).alias(name))
    total = df.agg(F.count("*")).scalar()
    return (
        rows.groupBy(name)
        .agg(F.count("*").alias("n"))
        .select(name, "n", (F.col("n") / total).alias("share"))
    )


def rule_shares(df: DataFrame, text: Column, rules: dict[str, str]) -> DataFrame:
    """Rows hit by each text rule and their share of all rows, from one scan."""
    counted = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(text.rlike(any_of([rx]))).alias(r) for r, rx in rules.items()],
    )
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])
    return counted.select("_rows", F.inline(rows)).select(
        "rule", "n", (F.col("n") / F.col("_rows")).alias("share")
    )


def feed_tallies(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: keys by the feeds that hold them, and per shared column the keys on which both agree."""
    a = left.select(key, F.struct(*columns).alias("a"))
    b = right.select(key, F.struct(*columns).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return a.join(b, key, "full_outer").agg(
        F.count("*").alias("keys"),
        F.count_if(both).alias("in_both"),
        F.count_if(F.col("b").isNull()).alias("left_only"),
        F.count_if(F.col("a").isNull()).alias("right_only"),
        *[F.count_if(both & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"{c}_match") for c in columns],
    )


def match_rates(tallies: DataFrame, columns: list[str]) -> DataFrame:
    """Agreeing keys as shares of the keys in both feeds, NULL where there are none."""
    return tallies.withColumns({f"{c}_match": F.try_divide(f"{c}_match", "in_both") for c in columns})


def feed_agreement(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: coverage of two feeds on a key and match rate per shared column."""
    return match_rates(feed_tallies(left, right, key, columns), columns)


def ingest_report(normalised: DataFrame, arrivals: DataFrame, responses: DataFrame) -> DataFrame:
    """``(metric, detail, n)`` rows of one ingest run.

    ``responses`` is triaged, ``normalised`` carries ``reject_reason``, ``arrivals`` is the
    reduced set tagged inserted or refreshed with make and model. Each input is read once.
    """

    def entry(metric: Column, detail: Column | str = "") -> Column:
        text = F.lit(detail) if isinstance(detail, str) else detail
        return F.struct(metric.alias("metric"), text.alias("detail"))

    def tally(df: DataFrame, by: list[str], *entries: Column) -> DataFrame:
        counts = df.groupBy(*by).agg(F.count("*").alias("n"))
        return counts.select(F.explode(F.array_compact(F.array(*entries))).alias("_e"), "n")

    always = ("keys_attempted", "keys_failed", "fetched", "distinct", "inserted", "refreshed")
    reason, failed = F.col("reject_reason"), F.col("failure").isNotNull()
    parts = (
        tally(
            responses, ["failure"], entry(F.lit("keys_attempted")),
            F.when(failed, entry(F.lit("keys_failed"))),
        ),
        tally(
            normalised, ["reject_reason"], entry(F.lit("fetched")),
            F.when(reason.isNotNull(), entry(F.lit("dropped"), reason)),
        ),
        tally(
            arrivals, ["make", "model", "arrival"], entry(F.lit("distinct")), entry(F.col("arrival")),
            entry(F.lit("model_seen"), F.concat_ws(" ", "make", "model")),
        ),
        # A metric without rows is still reported, as zero.
        normalised.sparkSession.range(1).select(
            F.explode(F.array(*[entry(F.lit(m)) for m in always])).alias("_e"),
            F.lit(0).cast("bigint").alias("n"),
        ),
    )
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("_e").agg(F.sum("n").alias("n")).select("_e.metric", "_e.detail", "n")


def mentions(reports: DataFrame, component: str) -> DataFrame:
    """Reports whose full components contain one value."""
    return reports.filter(F.array_contains("components", component))


def sharing_components(pairs: DataFrame, reports: DataFrame) -> DataFrame:
    """Neighbour pairs ``(i, j, ...)`` with ``shared``: do both name a common component?

    Every pair stays; a report without components, or without a row, shares none.
    """
    scope = reports.select("odi_number", F.col("components").alias("c"))
    return (
        pairs.join(scope.select(F.col("odi_number").alias("i"), F.col("c").alias("_ci")), "i", "left")
        .join(scope.select(F.col("odi_number").alias("j"), F.col("c").alias("_cj")), "j", "left")
        .select(*pairs.columns, F.coalesce(F.arrays_overlap("_ci", "_cj"), F.lit(False)).alias("shared"))
    )


def top_k_sweep(pairs: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per seed and k: neighbours kept, those sharing a component, and the share lost to scoping.

    ``pairs`` is ``(i, j, sim, rk, shared)`` ranked at least to the largest k.
    """
    each = pairs.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).filter(
        F.col("rk") <= F.col("k")
    )
    return (
        each.groupBy(F.col("i").alias("seed"), "k")
        .agg(
            F.count("*").alias("kept"),
            F.count_if("shared").alias("scoped"),
            F.min("sim").alias("weakest"),
        )
        .withColumn("lost", 1 - F.col("scoped") / F.col("kept"))
    )

"""Secret scans over an incremental blob ledger, with Spark expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from fieldpulse.llm.rows import narrow, text_or_empty
from fieldpulse.runtime import as_table

LEDGER_FIELDS = (
    "blob binary", "rules array<string>", "findings array<struct<rule: string, start: bigint, stop: bigint>>",
)
LEDGER = ", ".join(LEDGER_FIELDS)


@dataclass(frozen=True)
class Rule:
    """A pattern of one version; a match counts if its ``group`` has ``min_chars`` or more.

    A change of the pattern takes a new version, so that every blob is scanned for it once more.
    """

    name: str
    version: int
    pattern: str
    group: int = 0
    min_chars: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))

# In the order in which findings at one start are listed.
RULES = (
    Rule("assign", 1, rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, min_chars=8),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, "[0-9a-f]{32,}"),
)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All entries of the ledger; none if it was never written."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        fields = (f"cast(null as {kind}) as {name}" for name, kind in (f.split(" ", 1) for f in LEDGER_FIELDS))
        return spark.range(0).selectExpr(*fields)


def _matches(rule: Rule) -> Column:
    """Matches in order: their number, the code points before each since the last one, and their sizes.

    The text between matches comes from a split at the same pattern, so positions need no offsets
    from the matcher. Texts without a match stop at the first test.
    """
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found = F.transform(
        F.arrays_zip(
            F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
            F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
            F.split(text, rule.pattern).alias("gap"),
        ),
        lambda m, i: F.struct(
            F.lit(rule.key).alias("rule"), i.alias("i"), F.length(m["gap"]).alias("gap"),
            F.length(m["whole"]).alias("size"), (F.length(m["value"]) >= rule.min_chars).alias("counts"),
        ),
    )
    wanted = F.array_contains("todo", rule.key) & text.rlike(rule.pattern)
    # The gap after the last match has no match beside it.
    return F.when(wanted, F.filter(found, lambda m: m["size"].isNotNull())).otherwise(F.slice(found, 1, 0))


def scan_new(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Ledger entries for the pairs of blob and rule version that ``ledger`` does not hold.

    ``versions`` is ``(path, blob, text)``. Of all versions that share a blob one is scanned.
    """
    first = versions.groupBy("blob").agg(F.min("path").alias("at"))
    seen = ledger.select("blob", F.explode("rules").alias("r")).groupBy("blob").agg(F.collect_set("r").alias("seen"))
    todo = F.array_except(F.array(*(F.lit(r.key) for r in rules)), F.coalesce("seen", F.array().cast("array<string>")))
    pending = as_table(
        first.join(seen, "blob", "left").select("at", F.col("blob").alias("key"), todo.alias("todo")).filter(F.size("todo") > 0),
        "secrets-pending",
    )
    side, small = narrow(pending, 7 + 3 * F.size("todo"))
    side = side if small else side.hint("shuffle_hash")
    scanned = versions.join(
        side, F.col("path").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("key"))
    ).select("blob", F.monotonically_increasing_id().alias("copy"), F.concat(*map(_matches, rules)).alias("matches"))
    order = Window.partitionBy("blob", "copy", "rule").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum("gap").over(order) + F.coalesce(F.sum("size").over(before), F.lit(0))
    spans = (
        scanned.filter(F.size("matches") > 0).repartition("blob").select("blob", "copy", F.inline("matches"))
        .select("blob", "rule", start.alias("start"), (start + F.col("size")).alias("stop"), "counts")
        .filter("counts")
        .groupBy("blob").agg(F.collect_set(F.struct("rule", "start", "stop")).alias("findings"))
    )
    return pending.select(F.col("key").alias("blob"), F.col("todo").alias("rules")).join(spans, "blob", "left").select(
        "blob", "rules", F.coalesce("findings", F.array().cast("array<struct<rule: string, start: bigint, stop: bigint>>")).alias("findings")
    )


def _versions(docs: DataFrame, path_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(path_col).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def record(docs: DataFrame, ledger_folder: str, path_col: str = "doc_id", text_col: str = "text",
           rules: Sequence[Rule] = RULES) -> None:
    """Scan what the ledger does not hold of ``docs`` and ``rules`` and append it, without a result by path."""
    versions = _versions(docs, path_col, text_col)
    scan_new(versions, read_ledger(docs.sparkSession, ledger_folder), rules).write.mode("append").parquet(ledger_folder)


def scan(docs: DataFrame, ledger_folder: str, path_col: str = "doc_id", text_col: str = "text",
         rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: ``(path, findings)``; new entries are appended to the ledger.

    Every row is a version of a file. ``findings`` is ``array<struct<start, rank, stop, rule>>`` by
    start, then in the order of ``rules``; positions are code points, ``stop`` is exclusive. A blob
    is known by the SHA-256 of its text, and each of its rule versions is scanned once, whatever
    the number of paths and runs. Null texts count as empty; a null path is a path like any other;
    repeated rows are returned each. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    paths = as_table(_versions(docs, path_col, text_col).select("path", "blob"), "secrets-paths")
    record(docs, ledger_folder, path_col, text_col, rules)

    rank = reduce(lambda chain, r: chain.when(F.col("f.rule") == r[1].key, r[0]), enumerate(rules[1:], 1),
                  F.when(F.col("f.rule") == rules[0].key, 0))
    current = (
        read_ledger(spark, ledger_folder).select("blob", F.explode("findings").alias("f"))
        .select("blob", "f.*", rank.alias("rank")).filter("rank is not null")
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct("start", "rank", "stop", F.split_part("rule", F.lit("@"), F.lit(1)).alias("rule")))).alias("findings"))
    )
    # Written, so that the join deals out the paths anew and one that very many share can be split.
    found = as_table(current, "secrets-found")
    empty = F.array().cast(found.schema["findings"].dataType)
    return paths.join(found, "blob", "left").select(F.col("path").alias(path_col), F.coalesce("findings", empty).alias("findings"))


def spelled(findings: Column) -> Column:
    """``kind:start:end`` of all findings, comma-joined."""
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", f["rule"], f["start"].cast("string"), f["stop"].cast("string"))), ","
    )

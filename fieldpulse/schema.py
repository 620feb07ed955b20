"""Table registry, schema evolution and integrity rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    name: str
    columns: str
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    parents: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)


_RECALL_KEY = ("campaign_number", "make", "model", "model_year")

# In dependency order: parents before children.
TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table(
            "complaints",
            "odi_number bigint, make string, model string, model_year smallint, "
            "components array<string>, components_coarse array<string>, source string, "
            "summary string, date_of_incident date, date_complaint_filed date, crash boolean, "
            "fire boolean, injuries smallint, deaths smallint, ingested_at timestamp, "
            "summary_stripped string, is_failure_report boolean",
            key=("odi_number",),
            required=("make", "model", "model_year", "source", "summary", "ingested_at"),
        ),
        Table(
            "recalls",
            "campaign_number string, make string, model string, model_year smallint, "
            "manufacturer string, component string, summary string, consequence string, "
            "remedy string, notes string, report_received_date date, park_it boolean, "
            "park_outside boolean, over_the_air_update boolean, ingested_at timestamp",
            key=_RECALL_KEY,
            required=("ingested_at",),
        ),
        Table(
            "complaint_embeddings",
            "odi_number bigint, embedding array<float>, model string, embedded_at timestamp, "
            "embedding_stripped array<float>",
            key=("odi_number",),
            required=("model", "embedded_at"),
            parents=((("odi_number",), "complaints", ("odi_number",)),),
        ),
        Table(
            "recall_embeddings",
            "campaign_number string, make string, model string, model_year smallint, "
            "embedding array<float>, model_name string, embedded_at timestamp",
            key=_RECALL_KEY,
            required=("model_name", "embedded_at"),
            parents=((_RECALL_KEY, "recalls", _RECALL_KEY),),
        ),
        Table(
            "patterns",
            "id bigint, name string, member_count int, recent_count int, baseline_count int, "
            "ratio double, severity string, state string, novelty_verdict string, "
            "novelty_recall_ref string, first_seen_at timestamp, updated_at timestamp",
            key=("id",),
            required=(
                "name", "member_count", "recent_count", "baseline_count", "state",
                "first_seen_at", "updated_at",
            ),
            defaults={"member_count": 0, "recent_count": 0, "baseline_count": 0, "state": "new"},
        ),
        Table(
            "novelty_history",
            "id bigint, pattern_id bigint, old_verdict string, old_recall_ref string, "
            "new_verdict string, new_recall_ref string, source string, changed_at timestamp",
            key=("id",),
            required=("pattern_id", "source", "changed_at"),
            parents=((("pattern_id",), "patterns", ("id",)),),
        ),
        Table(
            "pattern_members",
            "pattern_id bigint, odi_number bigint, similarity double",
            key=("pattern_id", "odi_number"),
            required=("similarity",),
            unique=(("odi_number",),),
            parents=(
                (("pattern_id",), "patterns", ("id",)),
                (("odi_number",), "complaints", ("odi_number",)),
            ),
        ),
    )
}


def conform(df: DataFrame, table: Table | str) -> DataFrame:
    """Cast, order and complete the columns of a table.

    Running it on an already conforming frame changes nothing; columns added to the
    registry later appear as NULL or their default; unknown columns are an error.
    """
    spec = TABLES[table] if isinstance(table, str) else table
    unknown = set(df.columns) - set(spec.schema.names)
    if unknown:
        raise ValueError(f"{spec.name} has no column {sorted(unknown)}")
    missing_key = set(spec.key) - set(df.columns)
    if missing_key:
        raise ValueError(f"{spec.name} needs its key column {sorted(missing_key)}")

    def column(f: T.StructField) -> Column:
        if f.name in df.columns:
            return F.col(f.name).cast(f.dataType).alias(f.name)
        return F.lit(spec.defaults.get(f.name)).cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in spec.schema.fields])


def _present(columns: tuple[str, ...]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


def key_text(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


# Rows of a task that counts keys.
_DEALT_ROWS = 500_000


def _dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Rows by key in ``parts`` tasks, ahead of their counting.

    Nearly every key is new, so a count before the shuffle only holds the keys of a whole split, and an explicit
    number keeps adaptive execution from merging small-looking parts.
    """
    return df.repartition(parts, *keys)


def violations(
    name: str, frames: dict[str, DataFrame], tables: dict[str, Table] | None = None, dealt_rows: int = _DEALT_ROWS
) -> DataFrame:
    """``(rule, key, n)``: broken rules of one table; empty when it is sound.

    A task counts about ``dealt_rows`` rows of the table or of a parent, so its memory does not follow theirs.
    """
    registry = TABLES if tables is None else tables
    spec, df = registry[name], frames[name]
    rows = df.count()
    parts = max(1, -(-rows // dealt_rows))
    found = []
    for label, cols in [("primary_key", spec.key)] + [("unique", u) for u in spec.unique]:
        found.append(
            _dealt(df.select(*cols), parts, *cols)
            .groupBy(*cols)
            .agg(F.count("*").alias("n"))
            .filter(F.col("n") > 1)
            .select(
                F.lit(f"{label}:{','.join(cols)}").alias("rule"), key_text(cols).alias("key"), "n"
            )
        )
    missing = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(f"not_null:{c}")) for c in spec.key + spec.required])
    )
    found.append(
        _dealt(df.select(F.explode(missing).alias("rule"), key_text(spec.key).alias("key")), parts, "rule", "key")
        .groupBy("rule", "key")
        .agg(F.count("*").alias("n"))
    )
    for cols, parent, parent_cols in spec.parents:
        if parent not in frames:
            continue
        keys = frames[parent].select(*[F.col(p).alias(c) for c, p in zip(cols, parent_cols)])
        both = max(parts, -(-keys.count() // dealt_rows))
        found.append(
            _dealt(df.select(*cols).filter(_present(cols)), both, *cols)
            .groupBy(*cols)
            .agg(F.count("*").alias("n"))
            .join(_dealt(keys, both, *cols), list(cols), "left_anti")
            .select(
                F.lit(f"foreign_key:{','.join(cols)}->{parent}").alias("rule"),
                key_text(cols).alias("key"),
                "n",
            )
        )
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def cascade(child: DataFrame, columns: tuple[str, ...], parent: DataFrame, parent_columns: tuple[str, ...]) -> DataFrame:
    """Child rows whose parent still exists."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in zip(columns, parent_columns)])
    return child.join(keys, list(columns), "left_semi")

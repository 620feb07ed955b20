"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.rows import BROADCAST_CELLS, ascii_lower, narrow, text_or_empty
from fieldpulse.runtime import as_table

PREFIX_CHARS = 128


def _levels() -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """The key of each level, one column finer each time."""
    size = {"_size": F.octet_length("_text")}
    prefix = {"_prefix": F.xxhash64(ascii_lower(F.substring("_text", 1, PREFIX_CHARS)))}
    # The normal form differs from the text in the case of A-Z only, so both have the same length.
    full = {"_full": F.sha2(ascii_lower(F.col("_text")), 256)}
    return size, size | prefix, size | prefix | full


def _shared(keyed: DataFrame, keys: list[str]) -> DataFrame:
    return keyed.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")


def _only(rows: DataFrame, keep: list[str], survivors: DataFrame, known: dict[str, Column], more: dict[str, Column],
          max_cells: int) -> DataFrame:
    """Rows whose keys survived so far, with the next key.

    While the surviving keys are few, they are broadcast and the next key is computed for
    surviving rows only. Beyond that, hashing every text in place is cheaper than moving
    texts to a join, so the hashes are joined instead. No text is ever shuffled.
    """
    side, small = narrow(survivors, 2, max_cells)
    keys = list(known)
    if small:
        return rows.withColumns(known).join(side, keys, "left_semi").select(
            *keep, *keys, *(c.alias(n) for n, c in more.items())
        )
    return rows.select(*keep, *(c.alias(n) for n, c in (known | more).items())).join(side, keys, "left_semi")


def repeated_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_cells: int = BROADCAST_CELLS) -> DataFrame:
    """Documents whose text occurs more than once:
    ``(doc_id, text_sha256, keep_id, group_size, n_rows)``.

    Texts are equal when identical after lower-casing A-Z. ``keep_id`` is the largest id of the
    group. A null text counts as empty; empty texts form a group like any other. Rows that repeat
    id and text count in ``group_size`` and are returned once, counted in ``n_rows``. A null id is smaller than any other.
    Other columns of the input are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    by_size, by_prefix, by_full = _levels()
    sizes = as_table(_shared(rows.select(by_size["_size"].alias("_size")), ["_size"]), "exact-sizes")
    prefixed = _only(rows, [], sizes, by_size, {"_prefix": by_prefix["_prefix"]}, max_cells)
    prefixes = as_table(_shared(prefixed, list(by_prefix)), "exact-prefixes")
    hashed = _only(rows, ["_id"], prefixes, by_prefix, {"_full": by_full["_full"]}, max_cells)
    keys = list(by_full)
    # Small rows of ids and hashes; written once because the groups and their members both need them.
    members = as_table(hashed.groupBy("_id", *keys).agg(F.count("*").alias("n_rows")), "exact-members")
    # Written, so that the join below deals out the members anew and a group with very many of them
    # is split by the skew join instead of following the aggregation's partitions.
    groups = as_table(
        members.groupBy(*keys).agg(F.max("_id").alias("keep_id"), F.sum("n_rows").alias("group_size"))
        .filter("group_size > 1"),
        "exact-groups",
    )
    return members.join(groups, keys).select(
        F.col("_id").alias(id_col), F.col("_full").alias("text_sha256"), "keep_id", "group_size", "n_rows"
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     max_cells: int = BROADCAST_CELLS) -> DataFrame:
    """One row per input row: ``(doc_id, keep_id, group_size, kept, text_sha256)``.

    See :func:`repeated_texts` for nulls, ties and empty texts. Rows that repeat id and text
    share one verdict.
    """
    found = repeated_texts(docs, id_col, text_col, max_cells).select(
        F.col(id_col).alias("_dup"), F.col("text_sha256").alias("_dup_sha"), F.col("keep_id").alias("_keep"), "group_size"
    )
    every = docs.select(F.col(id_col), F.sha2(ascii_lower(text_or_empty(text_col)), 256).alias("text_sha256"))
    both = every.join(
        found, F.col(id_col).eqNullSafe(F.col("_dup")) & (F.col("text_sha256") == F.col("_dup_sha")), "left"
    )
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("_keep")).otherwise(F.col(id_col))
    return both.select(
        id_col,
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        keep.eqNullSafe(F.col(id_col)).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts: that of the largest id; all columns stay.

    Of rows that repeat id and text one stays, whichever.
    """
    found = as_table(repeated_texts(docs, id_col, text_col), "exact-found")
    keys = (F.col(id_col).alias("__dup"), F.col("text_sha256").alias("__dup_sha"))
    stays = F.col("keep_id").eqNullSafe(F.col(id_col))
    losers, small = narrow(found.filter(~stays).select(*keys), 10)
    losers = losers if small else losers.hint("shuffle_hash")
    match = F.col(id_col).eqNullSafe(F.col("__dup")) & (F.col("__own_sha") == F.col("__dup_sha"))
    keyed = docs.withColumn("__own_sha", F.sha2(ascii_lower(text_or_empty(text_col)), 256))
    kept = keyed.join(losers, match, "left_anti")
    repeats = found.filter(stays & (F.col("n_rows") > 1)).select(*keys)
    if not repeats.isEmpty():
        once = kept.join(repeats, match, "left_semi").dropDuplicates([id_col, "__own_sha"])
        kept = kept.join(repeats, match, "left_anti").unionByName(once)
    return kept.drop("__own_sha")

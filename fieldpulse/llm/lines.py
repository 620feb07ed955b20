"""Line deduplication: a suffix array over line numbers by distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.llm.rows import map_texts, narrow, text_or_empty
from fieldpulse.runtime import as_table, cut

MIN_LINES = 3
MIN_WORDS = 25
_LAST_ID = (1 << 63) - 1


def running_start(df: DataFrame, order: Sequence[str], weight: str, name: str) -> DataFrame:
    """``df`` with the total of ``weight`` over all rows that come before in ``order``.

    Rows are dealt into ranges, summed inside each, and shifted by the totals of the lower ranges.
    Only one total per range is gathered.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum(weight).alias("_n"))
    # One row per shuffle range, so this window is bounded.
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_offset"))
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(weight).over(before), F.lit(0)) + F.col("_offset")
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, start.cast("bigint")).drop("_range", "_offset")


def _classes(members: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Intervals of the suffix array: suffixes that agree in ``keys``, two at least, in order.

    ``(keys, first, rank)``: ``first`` is the smallest position, ``rank`` the start of the interval.
    Written, so that a join deals out the members anew and a very large interval is split.
    """
    grouped = members.groupBy(*keys).agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return as_table(running_start(grouped, keys, "n", "rank").drop("n"), name)


def _deeper(active: DataFrame, step: int) -> DataFrame:
    """Suffixes that repeat at one depth, extended by what repeats ``step`` lines on in the same document.

    The prefix of twice the depth is the pair of the ranks here and there. A suffix whose second
    half is unique, or beyond its document, is unique from here on and leaves. ``w`` counts the words of
    the first line; ``words`` those of the whole prefix, as long as every step is one line.
    """
    on = active.select((F.col("pos") - step).alias("pos"), "last", F.col("rank").alias("r2"), F.col("words").alias("w2"))
    pairs = as_table(active.select("pos", "last", F.col("rank").alias("r1"), "w").join(on, ["pos", "last"]), "lines-pairs")
    classes = _classes(pairs, ["r1", "r2"], "lines-classes")
    return as_table(
        pairs.join(classes, ["r1", "r2"]).select("pos", "last", "rank", "first", "w", (F.col("w") + F.col("w2")).alias("words")),
        "lines-active",
    )


def _numbered(docs: DataFrame, id_col: str, text_col: str, counted: bool) -> tuple[DataFrame, DataFrame]:
    """``(row, id, sig, base, n)`` of the documents and ``(pos, last, h, g, w)`` of their lines.

    Documents follow one another by id in one sequence of lines; ``base`` is a document's start.
    ``w`` is the number of a line's words if they are ``counted``, else 0.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST_ID)).alias("id"), F.xxhash64(text).alias("sig"), text.alias("text")
    )

    def words(line: Column) -> Column:
        return F.size(F.filter(F.split(line, r"\s+"), lambda w: w != "")) if counted else F.lit(0)

    hashes = F.transform(
        F.split("text", "\n"), lambda line: F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"), words(line).alias("w"))
    )
    scanned = as_table(
        rows.select(F.monotonically_increasing_id().alias("row"), "id", "sig", hashes.alias("lines")), "lines-scan"
    )
    sized = scanned.select("row", "id", "sig", F.size("lines").alias("n"))
    placed = as_table(running_start(sized, ["id", "row"], "n", "base"), "lines-documents")
    every = scanned.select("row", "lines").join(placed.select("row", "base", "n"), "row").select(
        "base", (F.col("base") + F.col("n") - 1).alias("last"), F.posexplode("lines").alias("k", "line")
    )
    return placed, every.select((F.col("base") + F.col("k")).alias("pos"), "last", "line.h", "line.g", "line.w")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES,
                  min_words: int | None = None) -> DataFrame:
    """``(id, sig, n_lines, runs, longest)`` of every distinct document.

    ``runs`` lists, by their first line, the ranges of ``min_lines`` lines that have an earlier copy, in a
    document of smaller id or further up; with ``min_words`` also those of fewer lines that hold as many
    words. ``longest`` is the largest depth of the suffix array, ``min_lines`` times a power of two or
    that of a shorter run, at which a line of the document still has one.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    placed, lines = _numbered(docs, id_col, text_col, min_words is not None)
    lines = as_table(lines, "lines-lines")
    classes = _classes(lines, ["h", "g"], "lines-classes")
    active = as_table(
        lines.join(classes, ["h", "g"]).select("pos", "last", "rank", "first", "w", F.col("w").alias("words")), "lines-active"
    )

    def later(depth: int) -> DataFrame:
        return active.filter("pos <> first").select("pos", "last", F.lit(depth).alias("size"), "words")

    depth, shorter = 1, []
    while depth < min_lines:
        if min_words is not None:
            shorter.append(later(depth).filter(F.col("words") >= min_words))
        # Words are summed line by line, so every depth is visited if they count.
        step = min(depth, min_lines - depth) if min_words is None else 1
        active, depth = _deeper(active, step), depth + step
    copies = later(depth)
    for part in shorter:
        copies = copies.union(part)
    deepest = copies.groupBy("last").agg(F.max("size").alias("longest"))
    while not active.isEmpty():
        active, depth = _deeper(active, depth), depth * 2
        deepest = deepest.union(active.filter("pos <> first").groupBy("last").agg(F.lit(depth).alias("longest")))
    end = F.col("base") + F.col("n") - 1
    found = copies.groupBy("last").agg(F.collect_list(F.struct("pos", "size")).alias("at")).join(
        deepest.groupBy("last").agg(F.max("longest").alias("longest")), "last"
    )

    def span(run: Column) -> Column:
        start = (run["pos"] - F.col("base")).cast("int")
        return F.struct(start.alias("start"), (start + run["size"]).alias("stop"))

    spans = F.array_sort(F.transform(F.coalesce("at", F.array().cast("array<struct<pos: bigint, size: int>>")), span))
    return (
        placed.withColumn("last", end).join(found, "last", "left")
        .select("id", "sig", F.col("n").alias("n_lines"), spans.alias("runs"), F.coalesce("longest", F.lit(0)).alias("longest"))
        .groupBy("id", "sig").agg(*(F.first(c).alias(c) for c in ("n_lines", "longest")), F.min_by("runs", F.size("runs")).alias("runs"))
    )


def _cleaner(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts, removed = [], []
        for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True):
            if not runs:
                texts.append(text.as_py())
                removed.append([])
                continue
            lines, kept, ranges, upto = text.as_py().split("\n"), [], [], 0
            for r in runs:
                if ranges and r["start"] <= upto:
                    ranges[-1]["stop"] = upto = max(upto, r["stop"])
                else:
                    kept += lines[upto : r["start"]]
                    ranges.append(dict(r))
                    upto = r["stop"]
            texts.append("\n".join(kept + lines[upto:]))
            removed.append(ranges)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("n_lines"), pa.array([sum(r["stop"] - r["start"] for r in x) for x in removed], pa.int32()),
             batch.column("longest"), pa.array(removed, kind), pa.array(texts, pa.string())],
            ["doc", "n_lines", "n_removed", "longest", "removed", "text"],
        )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES,
                           min_words: int | None = None) -> DataFrame:
    """One row per input row: ``(doc_id, n_lines, n_removed, longest, removed, text)``.

    Every line inside a run of at least ``min_lines`` lines, or of at least ``min_words`` words if
    given, that has an earlier copy is deleted; overlapping runs merge to the maximal repeated run. ``removed`` lists the line ranges, ``text``
    joins the lines that stay. Null and empty texts are one empty line. Documents come in order of
    id, null ids last; rows that repeat an id come in the order of the scan, and rows that repeat id
    and text share the verdict of the first of them. Other columns are ignored; an empty table gives
    no rows.
    """
    found = as_table(repeated_runs(docs, id_col, text_col, min_lines, min_words), "lines-found")
    side, small = narrow(found, 5 + 2 * F.size("runs"))
    side = side if small else side.hint("shuffle_hash")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST_ID)).alias("id"),
        F.xxhash64(text_or_empty(text_col)).alias("sig"), text_or_empty(text_col).alias("text"),
    )
    joined = rows.join(side, ["id", "sig"]).select("doc", "n_lines", "longest", "runs", "text")
    fields = "doc bigint, n_lines int, n_removed int, longest int, removed array<struct<start: int, stop: int>>, text string"
    return map_texts(joined, _cleaner, fields).withColumnRenamed("doc", id_col)

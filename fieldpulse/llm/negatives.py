"""Hard negatives of anchors: a secondary-sort shuffle of packed scores, read as a stream of windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from fieldpulse.llm.rows import map_texts
from fieldpulse.runtime import as_table, spread

SCALE = 256
# Bytes of the anchors that one pass over the rows takes to every task; more anchors are more passes.
BLOCK_BYTES = 16 << 20
# Bytes of scores that a task holds at once.
SCORE_BYTES = 16 << 20
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
_SCORED = "anchor bigint, score bigint, id bigint"


@dataclass(frozen=True)
class Window:
    """How many positives open a window, how many negatives each emits, and its bounds in percent of the positive's score."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95

    def __post_init__(self) -> None:
        if self.positives < 1 or self.negatives < 1:
            raise ValueError("at least one positive and one negative")
        if not 0 <= self.low < self.high < 100:
            raise ValueError("percentages must be 0 <= low < high < 100")


def quantised(rows: DataFrame, id_col: str, label: Column, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``(id, label, vec)`` of the rows that take part, components as ``floor(scale * x)``.

    Rows without id, label or vector, or with a null or non-finite component, take no part. Rows that
    repeat an id are one row: that of the smallest label and vector.
    """
    x = F.col("_v").cast("array<double>")
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v))
    taken = (
        rows.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector_col).alias("_v"))
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("_v").isNotNull())
        .filter(~broken).select("id", F.struct("label", whole.alias("vec")).alias("row"))
    )
    return taken.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.vec")


def _block_scorer(anchors, score_bytes: int) -> tuple[Callable, Callable, Callable]:
    """Scoring of Arrow batches ``(id, label, vec)`` against a block of anchors.

    ``parts`` yields ``(ids, labels, scores)`` by ascending id with a line of scores per anchor, exact
    wherever they fit a long. ``best`` picks the highest allowed ones of each line, ties by position, that is
    by id. ``keep`` reduces what several parts picked.
    """
    shift = 14

    def matrix(column, width: int):
        import numpy as np

        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        width = max(width, int(sizes.max(initial=0)))
        out = np.zeros((len(column), width), np.int64)
        # Missing components count as zero.
        out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return out

    def parts(batch):
        import numpy as np

        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        own = anchors["vec"]
        vecs = matrix(batch.column(2), own.shape[1])
        if vecs.shape[1] > own.shape[1]:
            own = np.pad(own, ((0, 0), (0, vecs.shape[1] - own.shape[1])))
        order = np.argsort(ids, kind="stable")
        step = max(1, min(1 << shift, score_bytes // (8 * max(1, len(own)))))
        size = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
        in_doubles = size(own) * size(vecs) * max(1, own.shape[1]) < 2.0**53
        left = own.astype(np.float64) if in_doubles else own
        for at in range(0, len(order), step):
            part = order[at : at + step]
            right = vecs[part].astype(np.float64) if in_doubles else vecs[part]
            yield ids[part], labels[part], (left @ right.T).astype(np.int64)

    def best(scores, allowed, count: int):
        import numpy as np

        some = np.flatnonzero(allowed.any(axis=1))
        if not len(some):
            return some, some
        width = scores.shape[1]
        if width <= count or max(-int(scores.min()), int(scores.max())) >= 1 << (62 - shift):
            rows, cols = np.nonzero(allowed)
            order = np.lexsort((cols, -scores[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            top = np.arange(len(rows)) - np.searchsorted(rows, rows) < count
            return rows[top], cols[top]
        # Score and position in one number, different for all of a line.
        none = np.iinfo(np.int64).min
        keys = np.where(allowed[some], (scores[some] << shift) + (width - 1 - np.arange(width)), none)
        at = np.argpartition(keys, width - count, axis=1)[:, width - count :]
        held = np.take_along_axis(keys, at, axis=1).ravel() != none
        return np.repeat(some, count)[held], at.ravel()[held]

    def keep(found: list, count: int):
        import numpy as np

        lines, scores, ids = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((ids, -scores, lines))
        lines, scores, ids = lines[order], scores[order], ids[order]
        top = np.arange(len(lines)) - np.searchsorted(lines, lines) < count
        return lines[top], scores[top], ids[top]

    return parts, best, keep


def _collector(anchors, wanted: list[tuple], score_bytes: int) -> Callable[[Iterator], Iterator]:
    """A task that returns, for each line, the best ``count`` of its rows for every ``(allow, count)`` wanted.

    What a task holds and returns is bounded by the block of anchors, not by its rows.
    """
    parts, best, keep = _block_scorer(anchors, score_bytes)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        found: list[list] = [[] for _ in wanted]
        for batch in batches:
            for ids, labels, scores in parts(batch):
                for picked, (allow, count) in zip(found, wanted):
                    lines, at = best(scores, allow(anchors, ids, labels, scores), count)
                    picked.append((lines, scores[lines, at], ids[at]))
                    if sum(len(x[0]) for x in picked) > 1 << 18:
                        picked[:] = [keep(picked, count)]
        rows = [np.stack(keep(picked, count)) for picked, (_, count) in zip(found, wanted) if picked]
        if rows:
            lines, scores, ids = np.unique(np.concatenate(rows, axis=1), axis=1)
            for at in range(0, len(lines), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors["id"][lines[part]]), pa.array(scores[part]), pa.array(ids[part])], ["anchor", "score", "id"]
                )

    return run


def _same_label(anchors, ids, labels, scores):
    return (anchors["label"][:, None] == labels[None, :]) & (anchors["id"][:, None] != ids[None, :])


def _in_window(n: int) -> Callable:
    def allow(anchors, ids, labels, scores):
        inside = (scores >= anchors["least"][n][:, None]) & (scores <= anchors["most"][n][:, None])
        return inside & (anchors["label"][:, None] != labels[None, :])

    return allow


def _blocks(anchors: DataFrame, block_bytes: int) -> Iterator[dict]:
    """The anchors, a bounded block of NumPy arrays at a time."""
    import numpy as np

    size = anchors.agg(F.sum(8 * F.size("vec") + 100)).first()[0] or 0
    count = -(-size // block_bytes)
    placed = as_table(anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, count)))), "negatives-anchors")
    for n in range(count):
        held = placed.filter(F.col("block") == n).select("id", "label", "vec").toArrow().combine_chunks()
        if held.num_rows:
            vecs = held["vec"].to_pylist()
            block = np.zeros((len(vecs), max(map(len, vecs))), np.int64)
            for line, vec in zip(block, vecs):
                line[: len(vec)] = vec
            yield {"id": held["id"].to_numpy(), "label": held["label"].to_numpy(), "vec": block}


def _with_bounds(anchors: dict, positives: list, window: Window) -> dict:
    """``anchors`` with the lowest and the highest score of each window; a missing window holds none."""
    import numpy as np

    line = {int(a): n for n, a in enumerate(anchors["id"])}
    least = np.ones((window.positives, len(line)), np.int64)
    most = np.zeros((window.positives, len(line)), np.int64)
    for r in positives:
        least[r["rk"] - 1, line[r["anchor"]]] = -(-window.low * r["score"] // 100)
        most[r["rk"] - 1, line[r["anchor"]]] = window.high * r["score"] // 100
    return anchors | {"least": least, "most": most}


def scored_pairs(base: DataFrame, anchors: DataFrame, window: Window, block_bytes: int = BLOCK_BYTES,
                 score_bytes: int = SCORE_BYTES) -> DataFrame:
    """``(anchor, score, id, same)``: all pairs that open a window or can be emitted from one.

    A first pass finds the positives of a block of anchors, a second what lies in their windows; both score
    every row against the block and return bounded lists per task. No pair of the result is missing from them,
    because the first rows of a window are among the first rows of each task's share of it.
    """
    found = []
    for block in _blocks(anchors, block_bytes):
        near = map_texts(base, _collector(block, [(_same_label, window.positives)], score_bytes), _SCORED)
        by_anchor = Over.partitionBy("anchor").orderBy(F.col("score").desc(), "id")
        positives = as_table(
            near.withColumn("rk", F.row_number().over(by_anchor)).filter(F.col("rk") <= window.positives), "negatives-positives"
        )
        # At most `window.positives` rows for each anchor of the block.
        bounded = _with_bounds(block, positives.collect(), window)
        wanted = [(_in_window(n), window.negatives) for n in range(window.positives)]
        others = as_table(map_texts(base, _collector(bounded, wanted, score_bytes), _SCORED), "negatives-others")
        found += [positives.drop("rk").withColumn("same", F.lit(True)), others.withColumn("same", F.lit(False))]
    if not found:
        return base.sparkSession.createDataFrame([], f"{_SCORED}, same boolean")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _packer() -> tuple[Callable, Callable, Callable]:
    """``(pack, unpack, anchor_of)``: 24 bytes that sort by anchor, descending score, id."""
    bias, size = 1 << 63, 8

    def pack(anchor: int, score: int, number: int) -> bytes:
        return b"".join(x.to_bytes(size, "big") for x in (anchor + bias, bias - 1 - score, number + bias))

    def unpack(key: bytes) -> tuple[int, int, int]:
        a, s, n = (int.from_bytes(key[at : at + size], "big") for at in (0, size, 2 * size))
        return a - bias, bias - 1 - s, n - bias

    def anchor_of(key: bytes) -> int:
        return (int.from_bytes(key[:size], "big") * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32

    return pack, unpack, anchor_of


def _streamer(window: Window, unpack: Callable) -> Callable[[Iterator], Iterator]:
    """Reads sorted ``(key, same)`` and emits negatives; holds the open windows of one anchor only."""
    positives, negatives, low, high = window.positives, window.negatives, window.low, window.high

    def run(rows: Iterator) -> Iterator:
        current, seen, opened, zeros = None, 0, [], []
        for key, same in rows:
            anchor, score, number = unpack(key)
            if anchor != current:
                current, seen, opened, zeros = anchor, 0, [], []
            if same:
                if seen < positives:
                    seen += 1
                    one = [number, score, 0]
                    # Only where both scores are zero can a negative come before its positive.
                    for other in zeros if score == 0 else ():
                        one[2] += 1
                        yield anchor, number, one[2], other, 0, 0
                    if one[2] < negatives:
                        opened.append(one)
                continue
            for one in opened:
                if one[2] < negatives and low * one[1] <= 100 * score <= high * one[1]:
                    one[2] += 1
                    yield anchor, one[0], one[2], number, one[1], score
            opened = [one for one in opened if one[2] < negatives and low * one[1] <= 100 * score]
            if score == 0 and len(zeros) < negatives:
                zeros.append(number)

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: Column | None = None,
                   vector_col: str = "embedding", window: Window = Window(), scale: int = SCALE,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Scores are inner products of components ``floor(scale * x)``; higher ones come first, ties by smaller id. The
    first ``window.positives`` other rows of an anchor's label open a window each, from ``low`` to ``high``
    percent of their score, and the first ``window.negatives`` rows of other labels in it are returned.
    ``is_anchor`` is a condition on the column ``id``. :func:`quantised` states which rows take part; vectors
    of different lengths compare as if padded with zeros; scores are exact where they fit a long. A window
    of a negative positive is empty. Other columns are ignored; no anchors or an empty table give no rows.

    The pairs are shuffled by anchor under packed keys (anchor, descending score, id) and sorted inside the
    partitions, so an anchor is read as a stream whatever its number of rows.
    """
    label = F.col("label") if label is None else label
    spark = rows.sparkSession
    base = spread(as_table(quantised(rows, id_col, label, vector_col, scale), "negatives-rows"))
    pairs = as_table(scored_pairs(base, base.filter(is_anchor), window, block_bytes), "negatives-pairs")
    pack, unpack, anchor_of = _packer()
    # A variable of plain functions travels by value; the session's number of shuffle partitions holds here too.
    keyed = pairs.rdd.map(lambda r: (pack(r[0], r[1], r[2]), r[3]))
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionAndSortWithinPartitions(count, anchor_of)
    return spark.createDataFrame(ordered.mapPartitions(_streamer(window, unpack)), RESULT)

"""Fill-in-the-middle over whole lines, cut through a learned index from line rank to text offset."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.rows import map_texts, text_or_empty

SEED = "7"
# Marks in front of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
# Percent of documents that are cut, and of those the percent whose suffix comes first.
CUT_PERCENT = 100
SUFFIX_FIRST_PERCENT = 50
# A predicted offset is off by at most this many characters (and one of rounding) before it is corrected.
MAX_ERROR = 256


def _learner(max_error: int) -> tuple[Callable, Callable, Callable]:
    """``(boundaries, fit, locate)``, the index over the line boundaries of one text.

    ``boundaries`` are the offsets of all cuts between lines, 0 and the length included. ``fit`` covers them
    by segments ``(first rank, its offset, slope)``: the cone of slopes that keep every boundary of a
    segment within ``max_error`` shrinks until it is empty, which starts the next one. What the
    prediction misses is kept as a residual of 16 bits, so ``locate`` is exact.
    """
    first_window = 64

    def boundaries(text: str):
        import numpy as np

        chars = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), "<u4")
        ends = np.flatnonzero(chars == ord("\n")) + 1
        last = [len(text)] if len(text) and (not len(ends) or ends[-1] != len(text)) else []
        return np.concatenate([[0], ends, last]).astype(np.int64)

    def longest(offsets, at: int):
        """``(slope, end)`` of the segment that begins at rank ``at``; ranks below ``end`` belong to it."""
        import numpy as np

        low, high, start, window = 0.0, np.inf, at + 1, first_window
        while start < len(offsets):
            rise, run = offsets[start : start + window] - offsets[at], np.arange(start - at, min(start + window, len(offsets)) - at)
            lows = np.maximum.accumulate(np.maximum((rise - max_error) / run, low))
            highs = np.minimum.accumulate(np.minimum((rise + max_error) / run, high))
            empty = np.flatnonzero(lows > highs)
            stop = int(empty[0]) if len(empty) else len(rise)
            if stop:
                low, high = float(lows[stop - 1]), float(highs[stop - 1])
            start += stop
            if len(empty):
                break
            window *= 2
        return (low if high == np.inf else (low + high) / 2), start

    def predict(index, ranks):
        import numpy as np

        starts, bases, slopes = index[:3]
        at = np.searchsorted(starts, ranks, "right") - 1
        return bases[at] + np.rint(slopes[at] * (ranks - starts[at])).astype(np.int64)

    def fit(offsets):
        import numpy as np

        starts, slopes, at = [], [], 0
        while at < len(offsets):
            slope, end = longest(offsets, at)
            starts.append(at)
            slopes.append(slope)
            at = end
        starts = np.array(starts, np.int64)
        index = (starts, offsets[starts], np.array(slopes, np.float64))
        missed = offsets - predict(index, np.arange(len(offsets)))
        return *index, missed.astype(np.int16)

    def locate(index, ranks):
        import numpy as np

        ranks = np.asarray(ranks, np.int64)
        return predict(index, ranks) + index[3][ranks]

    return boundaries, fit, locate


def _check_error(max_error: int) -> None:
    if not 1 <= max_error < 1 << 14:
        raise ValueError("max_error must be at least 1 and below 16384, so that residuals fit 16 bits")


def rank_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_error: int = MAX_ERROR) -> DataFrame:
    """The index of every text: ``(id, n, starts, bases, slopes, residuals)``.

    The boundary after ``k`` of the ``n`` lines lies at ``bases[s] + rint(slopes[s] * (k - starts[s])) +
    residuals[k]``, where ``s`` is the last segment that starts at ``k`` or before. A null or empty text
    has no line and one boundary.
    """
    _check_error(max_error)
    boundaries, fit, _ = _learner(max_error)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def lists(values):
            offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))

        for batch in batches:
            if not batch.num_rows:
                continue
            found = [fit(boundaries(t.as_py())) for t in batch.column(1)]
            counts = pa.array([len(f[3]) - 1 for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), counts, *(lists([f[k] for f in found]) for k in range(4))],
                ["id", "n", "starts", "bases", "slopes", "residuals"],
            )

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_texts(
        rows, run, f"id {kind}, n bigint, starts array<bigint>, bases array<bigint>, slopes array<double>, residuals array<smallint>"
    ).withColumnRenamed("id", id_col)


def _draw(id_col: str, seed: str, k: int) -> Column:
    """The ``k``-th 32-bit number of a document: digits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be found again beside any text that holds none of them."""
    if any(not m or m[0] in m[1:] for m in marks) or len({m[0] for m in marks}) > 1:
        raise ValueError("marks must start with one character that does not occur in them again")
    if any(b.startswith(a) for a, b in permutations(marks, 2)):
        raise ValueError("no mark may start with another one")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED,
                   marks: tuple[str, str, str] = MARKS, cut_percent: int = CUT_PERCENT,
                   suffix_first_percent: int = SUFFIX_FIRST_PERCENT, max_error: int = MAX_ERROR) -> DataFrame:
    """One row per input row: ``(id, n, form, prefix_chars, middle_chars, output, n_segments)``.

    A text of ``n`` lines is cut after two numbers of lines drawn from ``0..n`` by a hash of seed and id; the cuts'
    offsets are predicted by the text's learned index and corrected by its residuals. ``form`` is ``psm``
    (prefix, suffix, middle), ``spm`` (suffix, prefix, middle), or ``plain`` for texts that are null,
    empty, hold a mark, or are not among the ``cut_percent``; a plain output is the text itself and has no
    cuts (null counts). A null id draws like an empty one; rows that repeat an id draw alike, each over
    its own lines. Other columns are ignored; an empty table gives no rows. Texts never leave their row: no shuffle.
    """
    _check_error(max_error)
    check_marks(marks)
    boundaries, fit, locate = _learner(max_error)
    p, s, m = marks

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = []
            for text, one, two, cut, suffix_first in zip(*(c.to_pylist() for c in batch.columns[1:])):
                index = fit(boundaries(text))
                n = len(index[3]) - 1
                if not cut or not text or p in text or s in text or m in text:
                    found.append((n, "plain", None, None, text, len(index[0])))
                    continue
                one, two = one % (n + 1), two % (n + 1)
                a, b = locate(index, [min(one, two), max(one, two)]).tolist()
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                if suffix_first:
                    form, output = "spm", f"{s}{suffix}{p}{prefix}{m}{middle}"
                else:
                    form, output = "psm", f"{p}{prefix}{s}{suffix}{m}{middle}"
                found.append((n, form, a, b - a, output, len(index[0])))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32())
            cells = zip(*found) if found else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cells, kinds))],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output", "n_segments"],
            )

    rows = docs.select(
        F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"),
        _draw(id_col, seed, 0).alias("one"), _draw(id_col, seed, 1).alias("two"),
        (_draw(id_col, seed, 2) % 100 < cut_percent).alias("cut"),
        (_draw(id_col, seed, 3) % 100 < suffix_first_percent).alias("suffix_first"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    return map_texts(
        rows, run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, n_segments int"
    ).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that :func:`fill_in_middle` was given, from its output and form alone."""
    p, s, m = marks

    def pieces(first: str, second: str) -> Column:
        """What stands after the first mark, after ``second`` and after the middle's."""
        return F.split(F.substr(output, F.lit(len(first) + 1)), f"{re.escape(second)}|{re.escape(m)}", -1)

    psm, spm = pieces(p, s), pieces(s, p)
    return (
        F.when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
        .when(form == "spm", F.concat(spm[1], spm[2], spm[0]))
        .otherwise(output)
    )

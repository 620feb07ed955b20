"""Substring deduplication over sliding runs of consecutive sentences."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.rows import map_texts, narrow, text_or_empty
from fieldpulse.runtime import as_table

MIN_SENTENCES = 2
MIN_WORDS = 25
SINGLE_WORDS = 50
SEED = 11

_RUN = "struct<h: bigint, g: int, i: int, j: int, fresh: boolean>"
_SCAN = f"row bigint, id bigint, sig bigint, bounds array<int>, runs array<{_RUN}>"


def _scanner(min_sentences: int, min_words: int, single_words: int | None):
    def run(batches: Iterator) -> Iterator:
        import re

        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        # A sentence ends with the white space after a stop, at a wide stop, or at line feeds.
        edge = re.compile(r"[.!?]+[)\]\"'»”]*\s+|[。！？]+\s*|\n\s*")
        digest = xxhash.xxh3_128_intdigest
        row = TaskContext.get().partitionId() << 33
        fields = list(pa.struct([("h", pa.int64()), ("g", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("fresh", pa.bool_())]))

        def runs_of(text: str) -> tuple[list[int], tuple[list, ...]]:
            """Sentence bounds, and the runs from and up to each sentence: hash parts, first and last sentence, news."""
            bounds = [0, *(m.end() for m in edge.finditer(text))]
            if bounds[-1] < len(text):
                bounds.append(len(text))
            words = [text[a:b].split() for a, b in zip(bounds, bounds[1:])]
            if not words or len(words) < min_sentences and single_words is None:
                return bounds, ([], [], [], [], [])
            spelled = [" ".join(w).encode().lower() for w in words]
            size = np.cumsum([len(w) for w in words])
            before = np.concatenate([[0], size[:-1]])
            first = np.arange(len(words))
            last = np.maximum(first + min_sentences - 1, np.searchsorted(size, before + min_words))
            begin = np.minimum(first - min_sentences + 1, np.searchsorted(before, size - min_words, "right") - 1)
            pairs = {*zip(first[last < len(words)].tolist(), last[last < len(words)].tolist(), strict=True)}
            pairs |= {*zip(begin[begin >= 0].tolist(), first[begin >= 0].tolist(), strict=True)}
            if single_words is not None:
                pairs |= {(k, k) for k, w in enumerate(words) if len(w) >= single_words}
            first, last = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
            ends = np.cumsum([len(s) + 1 for s in spelled])
            begins = np.concatenate([[0], ends[:-1]])
            joined = b" ".join(spelled)
            hashes = [digest(joined[a:b], SEED) for a, b in zip(begins[first].tolist(), (ends[last] - 1).tolist(), strict=True)]
            seen: set[int] = set()
            fresh = [h not in seen and not seen.add(h) for h in hashes]
            return bounds, (
                [(h & (1 << 64) - 1) - (1 << 63) for h in hashes], [(h >> 64 & (1 << 32) - 1) - (1 << 31) for h in hashes],
                first.tolist(), last.tolist(), fresh,
            )

        def packed(rows: list[int], ids: list, sigs: list, bounds: list, runs: list, counts: list[int]):
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            columns = [[x for r in runs for x in r[c]] for c in range(5)]
            structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(sigs, pa.int64()),
                 pa.array(bounds, pa.list_(pa.int32())), pa.ListArray.from_arrays(offsets, structs)],
                ["row", "id", "sig", "bounds", "runs"],
            )

        for batch in batches:
            held: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, sig, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                bounds, runs = runs_of(text.as_py())
                for part, value in zip(held, (row, doc, sig, bounds, runs, len(runs[0])), strict=True):
                    part.append(value)
                row += 1
                if sum(held[5][-512:]) > 100_000 or len(held[0]) >= 512:
                    yield packed(*held)
                    held = ([], [], [], [], [], [])
            if held[0]:
                yield packed(*held)

    return run


def _merger(batches: Iterator) -> Iterator:
    """Covered sentences of each document as a count and as code point ranges."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        removed, ranges = [], []
        for bounds, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            n = len(bounds) - 1
            change = np.zeros(n + 1, np.int64)
            for s in spans or ():
                change[s["i"]] += 1
                change[s["j"] + 1] -= 1
            covered = np.concatenate([[False], np.cumsum(change)[:n] > 0, [False]])
            turns = np.flatnonzero(covered[1:] != covered[:-1])
            removed.append(int(covered.sum()))
            ranges.append([{"start": bounds[a], "stop": bounds[b]} for a, b in zip(turns[::2], turns[1::2], strict=True)])
        sizes = pa.array([len(b) - 1 for b in batch.column(2).to_pylist()], pa.int32())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), sizes, pa.array(removed, pa.int32()), pa.array(ranges, kind)],
            ["id", "sig", "n_sentences", "n_removed", "removed"],
        )


def _cleaner(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = []
        for text, ranges in zip(batch.column("text"), batch.column("removed").to_pylist(), strict=True):
            text, at, kept = text.as_py(), 0, []
            for r in ranges:
                kept.append(text[at : r["start"]])
                at = r["stop"]
            texts.append("".join(kept) + text[at:])
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, pa.string()))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, single_words: int | None = None) -> DataFrame:
    """``(id, sig, n_sentences, n_removed, removed)`` of every distinct document.

    ``sig`` is the hash of its text; ``removed`` are code point ranges. From every sentence on, and
    up to every sentence, the shortest run of at least ``min_sentences`` sentences and ``min_words``
    words is hashed (words joined by one space, A-Z lower-cased); together these cover every longer
    run. With ``single_words`` one sentence of as many words is a run, too. A run is first in the document of the smallest id that
    has it, and there at its first place; sentences that any other place of the run covers are
    removed. Rows that repeat an id count as one document; null ids count as the largest.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1)).alias("id"),
        F.xxhash64(text_or_empty(text_col)).alias("sig"), text_or_empty(text_col).alias("text"),
    )
    scanned = as_table(map_texts(rows, _scanner(min_sentences, min_words, single_words), _SCAN), "spans-scan")
    runs = scanned.select("row", "id", F.inline("runs"))
    news = runs.filter("fresh")
    # Written, so that the join deals out the runs anew and one that very many documents share is split.
    repeated = as_table(
        news.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1").drop("n"),
        "spans-repeated",
    )
    later = news.join(repeated, ["h", "g"]).filter("id <> first").select("row", "i", "j")
    again = runs.filter("not fresh").select("row", "i", "j")
    covers = later.union(again).groupBy("row").agg(F.collect_list(F.struct("i", "j")).alias("spans"))
    placed = scanned.select("row", "id", "sig", "bounds").join(covers, "row", "left").select("id", "sig", "bounds", "spans")
    return placed.mapInArrow(
        _merger, "id bigint, sig bigint, n_sentences int, n_removed int, removed array<struct<start: int, stop: int>>"
    ).dropDuplicates(["id", "sig"])


def without_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS,
                           single_words: int | None = None) -> DataFrame:
    """One row per input row: ``(doc_id, n_sentences, n_removed, removed, text)``, ``text`` without the repeats.

    Null and empty texts have no sentence and stay empty. Rows that repeat an id share what is
    first; see :func:`repeated_spans`. Other columns are ignored; an empty table gives no rows.
    """
    found = as_table(repeated_spans(docs, id_col, text_col, min_sentences, min_words, single_words), "spans-found")
    side, small = narrow(found, 4 + 3 * F.size("removed"))
    side = side if small else side.hint("shuffle_hash")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1)).alias("id"),
        F.xxhash64(text_or_empty(text_col)).alias("sig"), text_or_empty(text_col).alias("text"),
    )
    joined = rows.join(side, ["id", "sig"]).select("doc", "n_sentences", "n_removed", "removed", "text")
    return map_texts(joined, _cleaner, joined.schema).withColumnRenamed("doc", id_col)

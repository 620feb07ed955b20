"""Benchmark decontamination: a prefix-filtered set join with exact verification of windows."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.llm.rows import ascii_lower, drop_ids, map_texts, text_or_empty
from fieldpulse.runtime import as_table

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
# Shingles of the benchmark per pass over the documents, 8 bytes and at most 16 bits of a table each. Bounds what
# the driver gathers and tasks receive.
BLOCK_KEYS = 2_000_000
FLUSH_WORDS = 500_000
REMEMBERED_WORDS = 500_000
ROWS_OUT = 100_000
PLACES_OUT = 10_000
SEED = 42
FACTOR = 0x9E3779B97F4A7C15
PIECE_BYTES = 1 << 20

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_SEPARATORS = bytes((*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"({WORD})"), F.lit(1))


def windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text",
            window_words: int = WINDOW_WORDS) -> DataFrame:
    """``(item, window)``: every run of ``window_words`` words of an item, or all words of a shorter one."""
    spelled = items.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(text_or_empty(text_col)).alias("w")
    ).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window_words + 1, F.lit(1)))
    return (
        spelled.select("item", "w", F.explode(starts).alias("s"))
        .select("item", F.array_join(F.slice("w", F.col("s"), F.lit(window_words)), " ").alias("window"))
        .distinct()
    )


class WordHashes(dict):
    """Hash of a word, remembered for the words met last."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def _shingle_keys(hashes, k: int):
    """The key of the ``k`` words from each word on, as int64."""
    import numpy as np

    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    keys = np.full(n, k, np.uint64)
    for j in range(k):
        keys = (keys ^ hashes[j : n + j]) * np.uint64(FACTOR)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _window_keys(shingle_words: int):
    """Batches of windows to ``(window, length, keys)``: the keys of the shingles of each, in order."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        memory = WordHashes()
        for batch in batches:
            lengths, keys = [], []
            for window in batch.column(0):
                hashes = np.array([memory[w] for w in window.as_py().split(b" ")], np.uint64)
                lengths.append(len(hashes))
                keys.append(_shingle_keys(hashes, min(shingle_words, len(hashes))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["window", "length", "keys"]
            )

    return run


@dataclass(frozen=True)
class KeySet:
    """Sorted distinct keys, with a table of their low bits that turns most others away at once."""

    keys: object
    lows: object

    @staticmethod
    def of(keys) -> KeySet:
        import numpy as np

        lows = np.zeros(1 << max(10, (8 * len(keys)).bit_length()), bool)
        lows[keys & (len(lows) - 1)] = True
        return KeySet(np.sort(keys), lows)

    def places(self, found):
        """``(positions in found, index into keys)`` of the keys that are in the set."""
        import numpy as np

        at = np.flatnonzero(self.lows[found & (len(self.lows) - 1)]) if len(self.keys) else np.empty(0, np.int64)
        slot = np.searchsorted(self.keys, found[at])
        hit = self.keys[np.minimum(slot, len(self.keys) - 1)] == found[at] if len(at) else np.empty(0, bool)
        return at[hit], slot[hit]


def _hashed(batches: Iterator) -> Iterator:
    """Documents as ``(ids, folded texts, starts, hashes)``, several at a time; 0 stands after the last word of each.

    ``starts[n]`` is where the words of document ``n`` begin; a last entry closes the list.
    """
    import numpy as np

    fold = bytearray(range(256))
    for b in _SEPARATORS:
        fold[b] = 0x20
    for b in range(0x41, 0x5B):
        fold[b] = b + 0x20
    table, lookup = bytes(fold), WordHashes().__getitem__
    ids, texts, starts, flat = [], [], [0], array("Q")
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, at = text.as_py().translate(table), 0
            while at < len(data):
                stop = data.find(b" ", at + PIECE_BYTES)
                stop = len(data) if stop < 0 else stop
                flat.extend(map(lookup, data[at:stop].split()))
                at = stop
            flat.append(0)
            ids.append(doc)
            texts.append(data)
            starts.append(len(flat))
            if len(flat) >= FLUSH_WORDS:
                yield ids, texts, np.array(starts), np.frombuffer(flat, np.uint64)
                ids, texts, starts, flat = [], [], [0], array("Q")
    if ids:
        yield ids, texts, np.array(starts), np.frombuffer(flat, np.uint64)


def _found(wanted: KeySet, sizes: list[int], starts, hashes):
    """``(position, index of the key)`` of the wanted shingles, in order; none reaches into the next document."""
    import numpy as np

    spots, slots = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in sizes:
        at, slot = wanted.places(_shingle_keys(hashes, k))
        doc = np.searchsorted(starts, at, "right") - 1
        inside = at + k < starts[doc + 1]
        spots.append(at[inside])
        slots.append(slot[inside])
    at, slot = np.concatenate(spots), np.concatenate(slots)
    order = np.argsort(at, kind="stable")
    return at[order], slot[order]


def _counter(shared, sizes: list[int]):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        wanted = shared.value
        totals = np.zeros(len(wanted.keys), np.int64)
        for _, _, starts, hashes in _hashed(batches):
            slots, times = np.unique(_found(wanted, sizes, starts, hashes)[1], return_counts=True)
            totals[slots] += times
        seen = np.flatnonzero(totals)
        for n in range(0, len(seen), ROWS_OUT):
            part = seen[n : n + ROWS_OUT]
            yield pa.RecordBatch.from_arrays([pa.array(wanted.keys[part]), pa.array(totals[part])], ["key", "n"])

    return run


def _word_bounds(text: bytes):
    """Where each word of a folded text begins and ends."""
    import numpy as np

    blank = np.frombuffer(b" " + text + b" ", np.uint8) == 0x20
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return turns[::2], turns[1::2]


def _finder(shared, sizes: list[int], window_words: int):
    """A row for each document, and one for each anchor in it with the words around."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        wanted, row = shared.value, TaskContext.get().partitionId() << 33
        names = ["row", "id", "n_words", "key", "pos", "lead", "around"]
        reach = window_words - 1
        for ids, texts, starts, hashes in _hashed(batches):
            n_words = np.diff(starts) - 1
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), pa.array(ids, pa.int64()), pa.array(n_words), pa.nulls(n, pa.int64()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names
            )
            at, slot = _found(wanted, sizes, starts, hashes)
            doc = np.searchsorted(starts, at, "right") - 1
            bounds = np.searchsorted(doc, np.arange(n + 1))
            for d in np.unique(doc):
                begins, ends = _word_bounds(texts[d])
                for low in range(bounds[d], bounds[d + 1], PLACES_OUT):
                    high = min(low + PLACES_OUT, bounds[d + 1])
                    pos = at[low:high] - starts[d]
                    first, last = np.maximum(pos - reach, 0), np.minimum(pos + reach, n_words[d] - 1)
                    around = [b" ".join(texts[d][x:y].split()) for x, y in zip(begins[first], ends[last], strict=True)]
                    size = high - low
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, row + d)), pa.nulls(size, pa.int64()), pa.array(np.full(size, n_words[d])),
                         pa.array(wanted.keys[slot[low:high]]), pa.array(pos), pa.array((pos - first).astype(np.int32)),
                         pa.array(around, pa.binary())], names
                    )
            row += n

    return run


def _key_blocks(keys: DataFrame, block_keys: int) -> Iterator:
    """The distinct keys of a written one-column table as :class:`KeySet`, at most about ``block_keys`` at a time."""
    import numpy as np

    blocks = -(-keys.count() // block_keys)
    for n in range(blocks):
        mine = keys.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == n) if blocks > 1 else keys
        yield KeySet.of(np.asarray(mine.toArrow()["key"].to_numpy(), np.int64))


def _prefixes(rows: DataFrame, texts: DataFrame, shingle_words: int, block_keys: int) -> tuple[DataFrame, list[int]]:
    """``(window, length, key, offset)``: the rarest shingle of each window that may occur, and the shingle lengths."""
    spark = rows.sparkSession
    keyed = as_table(
        map_texts(texts.select(F.col("window").cast("binary")), _window_keys(shingle_words), "window binary, length int, keys array<bigint>"),
        "decontaminate-keys",
    )
    sizes = sorted(r[0] for r in keyed.select(F.least("length", F.lit(shingle_words))).distinct().collect())
    every = as_table(keyed.select(F.explode("keys").alias("key")).distinct(), "decontaminate-shingles")
    counted = []
    for wanted in _key_blocks(every, block_keys):
        shared = spark.sparkContext.broadcast(wanted)
        counts = map_texts(rows, _counter(shared, sizes), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
        counted.append(as_table(counts, "decontaminate-rarity"))
        shared.unpersist()
    rarity = reduce(DataFrame.union, counted, spark.range(0).select(F.col("id").alias("key"), F.col("id").alias("n")))
    # A window occurs only where all of its shingles do, so its rarest one is a sufficient prefix.
    listed = keyed.select("window", "length", F.size("keys").alias("size"), F.posexplode("keys").alias("offset", "key"))
    prefixes = (
        listed.join(rarity, "key")
        .groupBy("window", "length", "size").agg(F.count("*").alias("known"), F.min(F.struct("n", "offset", "key")).alias("p"))
        .filter("known = size")
        .select(F.col("window").cast("string").alias("window"), "length", "p.key", "p.offset")
    )
    return as_table(prefixes, "decontaminate-prefixes"), sizes


def _hits(rows: DataFrame, wanted: KeySet, prefixes: DataFrame, sizes: list[int], window_words: int) -> tuple[DataFrame, DataFrame]:
    """One pass: ``(row, id, n_words)`` of every document and ``(row, start, stop, window)`` of every hit."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)
    scanned = as_table(
        map_texts(
            rows, _finder(shared, sizes, window_words),
            "row bigint, id bigint, n_words bigint, key bigint, pos bigint, lead int, around binary",
        ),
        "decontaminate-scan",
    )
    shared.unpersist()
    start = F.col("pos") - F.col("offset")
    around = F.split(F.col("around").cast("string"), " ")
    hits = (
        scanned.filter("key is not null").drop("id").join(prefixes, "key")
        .filter((F.col("lead") >= F.col("offset")) & (start + F.col("length") <= F.col("n_words")))
        .filter(F.array_join(F.slice(around, F.col("lead") - F.col("offset") + 1, F.col("length")), " ") == F.col("window"))
        .select("row", start.alias("start"), (start + F.col("length")).alias("stop"), "window")
    )
    return scanned.filter("key is null").select("row", "id", "n_words"), as_table(hits, "decontaminate-hits")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window_words: int = WINDOW_WORDS,
                  shingle_words: int = SHINGLE_WORDS, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """One row per input row: ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``.

    Words are runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII. ``n_hit`` counts the
    words inside any occurrence of a window of any item, each once; ``n_items`` counts the item ids
    with an occurring window, and ``items_sha256`` is the digest of those ids, sorted as strings and
    comma-joined. Null and empty texts have no words; items without words have no window; a null
    item id is written as an empty string, and items that repeat an id are one item. Other columns
    are ignored. An empty benchmark gives no hit; an empty document table no rows.

    The benchmark is the stated query set. Its windows stay in tables; ``block_keys`` of their shingles
    at a time reach driver and tasks as numbers, first to count them in the documents, then the
    rarest of each window to find its places. Every block is a pass over the documents.
    """
    if window_words < 1 or shingle_words < 1 or block_keys < 1:
        raise ValueError("windows, shingles and blocks hold at least one")
    import numpy as np

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")
    )
    owners = as_table(windows(benchmark, item_col, item_text_col, window_words), "decontaminate-windows")
    prefixes, sizes = _prefixes(rows, owners.select("window").distinct(), shingle_words, block_keys)
    anchors = as_table(prefixes.select("key").distinct(), "decontaminate-anchors")
    if anchors.count() > block_keys:
        # Row numbers come from the order of the scan, so every pass has to read the same files.
        rows = as_table(rows, "decontaminate-rows")
    every, hits = None, None
    for wanted in _key_blocks(anchors, block_keys):
        counted, found = _hits(rows, wanted, prefixes, sizes, window_words)
        every, hits = every or counted, found if hits is None else hits.union(found)
    if every is None:
        every, hits = _hits(rows, KeySet.of(np.empty(0, np.int64)), prefixes, sizes, window_words)

    earlier = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.coalesce(F.max("stop").over(earlier), F.lit(0)))
    covered = (
        hits.select("row", "start", "stop").distinct()
        .select("row", F.greatest(F.col("stop") - reached, F.lit(0)).alias("new"))
        .groupBy("row").agg(F.sum("new").alias("n_hit"))
    )
    named = (
        hits.select("row", "window").distinct().join(owners, "window")
        .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    n_items = F.coalesce(F.size("items"), F.lit(0)).cast("bigint")
    return (
        every.join(covered.join(named, "row"), "row", "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.when(F.col("items").isNull(), F.lit(0)).otherwise(n_items).cast("bigint").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; all columns stay.

    Rows that repeat an id, or have none, share the verdict of the worst of them.
    """
    found = contamination(docs, benchmark, id_col, text_col).filter("contaminated").select(id_col)
    return drop_ids(docs, as_table(found, "decontaminate-losers"), id_col)

"""SimHash near-duplicates over a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.components import components
from fieldpulse.llm.rows import drop_ids, map_texts
from fieldpulse.runtime import as_table

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
# Postings with more distinct fingerprints than this are resolved without pairing their members.
LIST_ROWS = 64
RUN_BYTES = 1 << 20


def _hasher(shingle_words: int) -> Callable[[Iterator], Iterator]:
    def word_runs(data: bytes) -> Iterator[list[bytes]]:
        """Words in runs of about RUN_BYTES, so that a very long text needs little memory."""
        import re

        space, start = re.compile(rb"[\x20\x09-\x0d]"), 0
        while start < len(data):
            found = space.search(data, start + RUN_BYTES)
            stop = found.start() if found else len(data)
            yield data[start:stop].split()
            start = stop

    def fingerprint(data: bytes) -> int:
        import numpy as np
        import xxhash

        digest, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
        carried: list[bytes] = []
        for run in word_runs(data.lower()):
            words = carried + run
            if len(words) < shingle_words:
                carried = words
                continue
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            first, last = (ends - sizes)[: len(words) - shingle_words + 1].tolist(), ends[shingle_words - 1 :].tolist()
            hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
            total += len(hashes)
            carried = words[len(words) - shingle_words + 1 :] if shingle_words > 1 else []
        if not total:
            return digest(b" ".join(carried), SEED) if carried else 0
        return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(id, fp)``: the 64-bit fingerprint of every text, as a signed long.

    Words are runs of other characters than U+0020 and U+0009 to U+000D after lower-casing A-Z;
    UTF-8 makes both byte operations. A text of fewer words than a shingle is one shingle; a text
    without words, and a null text, has fingerprint 0.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")
    )
    return map_texts(rows, _hasher(shingle_words), "id bigint, fp bigint")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _half(fp: Column, block: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * block).bitwiseAND(F.lit(65535))


def _posting_keys(fp: Column) -> Column:
    """Six keys of four positional bytes each: any two of the four byte pairs.

    Fingerprints that differ in two bits differ in at most two bytes, so at least six of
    eight positional bytes, two whole byte pairs among them, are shared and one key is equal.
    A list for each single byte would hold 1/256 of all fingerprints, whatever their number.
    """
    return F.array(*(
        F.struct(F.lit(n).alias("slot"), F.shiftleft(_half(fp, i), 16).bitwiseOR(_half(fp, j)).alias("value"))
        for n, (i, j) in enumerate(combinations(range(4), 2))
    ))


def _free_bits(slot: int) -> list[int]:
    """Bits of the byte pairs that are not in the key ``slot``."""
    held = list(combinations(range(4), 2))[slot]
    return [b for b in range(64) if b // 16 not in held]


def _variants(slot: Column, fp: Column) -> Column:
    """``fp`` and its neighbours at one bit outside the key. As signed longs."""
    def flips(n: int) -> Column:
        masks = [0, *((1 << b) - (1 << 64 if b == 63 else 0) for b in _free_bits(n))]
        return F.transform(F.array(*map(F.lit, masks)), lambda m: fp.bitwiseXOR(m.cast("bigint")))

    chosen = F.when(slot == 0, flips(0))
    for n in range(1, 6):
        chosen = chosen.when(slot == n, flips(n))
    return chosen


def link_fingerprints(classes: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct fingerprints ``fp`` at two or fewer differing bits.

    Short posting lists are paired; the shared positional bytes of each pair are tallied, pairs
    with fewer than six are left out, and the rest is verified bit by bit. In a longer list pairs
    are never formed: members that share a neighbour at one bit differ in two bits at most, and
    members that differ in two bits at most share such a neighbour, so every member is tied to the
    smallest one at each of its 33 neighbours. Both ways connect the same fingerprints.
    """
    postings = classes.select("fp", F.explode(_posting_keys(F.col("fp"))).alias("key")).select("key.*", "fp")
    sizes = postings.groupBy("slot", "value").agg(F.count("*").alias("n")).filter("n > 1")
    listed = as_table(postings.join(sizes, ["slot", "value"]), "simhash-lists")

    short = listed.filter(F.col("n") <= list_rows)
    pairs = short.select("slot", "value", F.col("fp").alias("a")).join(
        short.select("slot", "value", F.col("fp").alias("b")), ["slot", "value"]
    ).filter("a < b")
    shared = sum(((_byte(F.col("a"), p) == _byte(F.col("b"), p)).cast("int") for p in range(8)), F.lit(0))
    differing = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    paired = pairs.filter(shared >= 8 - MAX_BITS).filter(differing <= MAX_BITS).select("a", "b")

    around = listed.filter(F.col("n") > list_rows).select(
        "slot", "fp", F.explode(_variants(F.col("slot"), F.col("fp"))).alias("near")
    )
    centres = around.groupBy("slot", "near").agg(F.min("fp").alias("b"), F.count("*").alias("m")).filter("m > 1")
    starred = around.join(centres, ["slot", "near"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return paired.union(starred).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, list_rows: int = LIST_ROWS) -> DataFrame:
    """One row per input row: ``(doc_id, fp, component_id)``.

    ``component_id`` is the smallest id among the documents linked by chains of fingerprints with
    two or fewer differing bits. Copies share a fingerprint and are never paired. Null and empty
    texts have fingerprint 0 and are linked like any other. Null ids are no component's name
    unless it has no other. Other columns are ignored; an empty table gives no rows.
    """
    prints = as_table(fingerprints(docs, id_col, text_col, shingle_words), "simhash-prints")
    classes = as_table(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-classes")
    linked = components(link_fingerprints(classes, list_rows))
    named = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = as_table(named.select("fp", "first_id", "root"), "simhash-named")
    # Written, so that the join deals out anew and splits a component of very many fingerprints.
    roots = as_table(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-roots")
    members = as_table(named.join(roots, "root").select("fp", "component_id"), "simhash-members")
    # A fingerprint that very many documents share is split by the skew join.
    return prints.join(members, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest id of each component; all columns stay.

    Rows that repeat an id share its verdict; a document with a null id stays only if all of its
    component have none.
    """
    found = near_duplicates(docs, id_col, text_col)
    losers = found.filter(~F.col("component_id").eqNullSafe(F.col(id_col))).select(id_col)
    return drop_ids(docs, as_table(losers, "simhash-losers"), id_col)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

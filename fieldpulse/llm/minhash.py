"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact check of the survivors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.components import components
from fieldpulse.llm.rows import drop_ids, map_texts, narrow
from fieldpulse.runtime import as_table

SHINGLE_WORDS = 2
MIN_PERCENT = 80
SEED = 42
_LAST_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Plan:
    """Signature layout and bounds of the candidate search.

    At a similarity of 0.8, 48 bands of 6 hashes miss a pair with probability (1 - 0.8**6)**48 = 5e-7.
    ``miss`` is the posterior probability below which a pair is dropped before all hashes are compared.
    A bucket of more than ``list_rows`` texts is compared in blocks of about ``left`` by ``right`` shingles.
    """

    bands: int = 48
    rows: int = 6
    batch: int = 24
    miss: float = 1e-7
    list_rows: int = 16
    left: int = 1 << 17
    right: int = 1 << 18

    def __post_init__(self) -> None:
        if min(self.bands, self.rows, self.batch, self.left, self.right) < 1 or self.list_rows < 2:
            raise ValueError("sizes must be positive, and a list holds two texts at least")
        if not 0 < self.miss < 0.5:
            raise ValueError("the miss probability lies between 0 and 0.5")


def _shingler(shingle_words: int) -> tuple[Callable, Callable]:
    """From a text's bytes to the sorted distinct 64-bit hashes of its shingles, and from these to a name."""
    run_bytes, seed = 1 << 20, SEED

    def word_hashes(data: bytes):
        """In runs, so that a very long text needs 8 bytes a word."""
        import re

        import numpy as np
        import xxhash

        digest, space, start = xxhash.xxh64_intdigest, re.compile(rb"[\x20\x09-\x0d]"), 0
        while start < len(data):
            found = space.search(data, start + run_bytes)
            stop = found.start() if found else len(data)
            words = data[start:stop].lower().split()
            yield np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))
            start = stop

    def shingles(data: bytes):
        import numpy as np

        runs = list(word_hashes(data))
        words = runs[0] if len(runs) == 1 else np.concatenate([np.zeros(0, np.uint64), *runs])
        size = min(shingle_words, len(words))
        if not size:
            return words
        h = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return np.unique(h)

    def name(h) -> tuple[int, int]:
        """128 bits that stand for a set."""
        import xxhash

        both = xxhash.xxh3_128_intdigest(h.tobytes(), seed)
        return (both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63)

    return shingles, name


def _signer(shingle_words: int, bands: int, rows: int) -> Callable[[Iterator], Iterator]:
    (shingles, name), chunk, seed = _shingler(shingle_words), 256, SEED

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rng = np.random.Generator(np.random.PCG64(seed))
        flips = rng.integers(0, 1 << 64, bands * rows, np.uint64)
        factors = rng.integers(0, 1 << 64, bands * rows, np.uint64) | np.uint64(1)
        numbers = rng.integers(0, 1 << 64, bands, np.uint64)

        def least(h):
            low = np.full(bands * rows, (1 << 64) - 1, np.uint64)
            for at in range(0, len(h), chunk):
                mixed = (h[at : at + chunk, None] ^ flips) * factors
                np.minimum(low, mixed.min(axis=0), out=low)
            return low

        for batch in batches:
            sizes, names, keys, codes = [], [], [], []
            for text in batch.column(1):
                h = shingles(text.as_py())
                sizes.append(len(h))
                names.append(name(h))
                if not len(h):
                    keys.append(np.zeros(0, np.int64))
                    codes.append(b"")
                    continue
                low = least(h)
                key = numbers.copy()
                for column in low.reshape(bands, rows).T:
                    key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                keys.append(key.view(np.int64))
                codes.append(((low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8).tobytes())
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            values = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([a for a, _ in names], pa.int64()),
                 pa.array([b for _, b in names], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                 pa.array(codes, pa.binary())],
                ["id", "n", "hi", "lo", "keys", "codes"],
            )

    return run


def least_matches(percent: int, hashes: int, batch: int, miss: float) -> list[int]:
    """For every further batch, how many of the hashes so far must be equal for a pair to stay.

    With a uniform prior on the similarity ``s`` and codes of 8 bits, ``m`` of ``k`` codes are equal with
    the likelihood of a binomial of ``s + (1 - s) / 256``. A pair goes as soon as the posterior
    probability of ``s >= percent / 100`` is below ``miss``.
    """
    import numpy as np

    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    similar = s >= percent / 100 - 1e-12
    out = []
    for k in range(batch, hashes + batch, batch):
        k = min(k, hashes)
        low, high = 0, k
        while low < high:
            m = (low + high) // 2
            logs = m * np.log(p) + (k - m) * np.log1p(-p)
            weight = np.exp(logs - logs.max())
            if weight[similar].sum() >= miss * weight.sum():
                high = m
            else:
                low = m + 1
        out.append(low)
    return out


def _pruner(needed: list[int], batch: int) -> Callable:
    """A function that compares code matrices batch by batch and returns the lines that stay."""
    def stay(left, right, at=None, to=None):
        """``left[at]`` with ``right[to]``, or line by line."""
        import numpy as np

        at = np.arange(len(left)) if at is None else at
        to = np.arange(len(right)) if to is None else to
        alive, equal = np.arange(len(at)), np.zeros(len(at), np.int32)
        for k, least in enumerate(needed):
            part = slice(k * batch, (k + 1) * batch)
            equal = equal + (left[at[alive], part] == right[to[alive], part]).sum(axis=1, dtype=np.int32)
            held = equal >= least
            alive, equal = alive[held], equal[held]
            if not len(alive):
                break
        return alive

    return stay


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b)) >= percent * F.greatest(a, b)


def _prune(pairs: DataFrame, codes: DataFrame, needed: list[int], batch: int) -> DataFrame:
    """Pairs ``(a, b)`` that the codes of their texts do not rule out."""
    stay = _pruner(needed, batch)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def matrix(column):
            raw = b"".join(column.to_pylist())
            return np.frombuffer(raw, np.uint8).reshape(len(column), -1)

        for part in batches:
            if part.num_rows:
                kept = pa.array(stay(matrix(part.column(2)), matrix(part.column(3))))
                yield pa.RecordBatch.from_arrays([part.column(0).take(kept), part.column(1).take(kept)], ["a", "b"])

    both = pairs.join(codes.select(F.col("cls").alias("a"), F.col("codes").alias("x")), "a").join(
        codes.select(F.col("cls").alias("b"), F.col("codes").alias("y")), "b"
    )
    return map_texts(both.select("a", "b", "x", "y"), run, "a bigint, b bigint")


def _ordered(u: Column, v: Column) -> list[Column]:
    return [F.least(u, v).alias("a"), F.greatest(u, v).alias("b")]


def star_pairs(listed: DataFrame, percent: int) -> DataFrame:
    """Every member of a bucket with its leader: the first of the bucket in one of four fixed orders.

    The few orders are shared by all bands, so a text meets few leaders in however many buckets.
    """
    order = F.xxhash64("cls", F.pmod("key", F.lit(4)))
    leads = as_table(listed.groupBy("key").agg(F.min_by(F.struct("cls", "n"), F.struct(order, F.col("cls"))).alias("lead")), "minhash-leads")
    met = listed.join(leads, "key").filter(F.col("cls") != F.col("lead.cls")).filter(_sizes_allow(F.col("n"), F.col("lead.n"), percent))
    return met.select(*_ordered(F.col("cls"), F.col("lead.cls"))).distinct()


def open_buckets(listed: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, cls, n, root, m, big, held, others)`` of the buckets of three and more texts that are not in one component.

    ``big`` marks the members of the bucket's component of the most texts; ``held`` counts the shingles of all
    members and ``others`` those of the rest. Buckets of two were compared whole by the first round.
    """
    three = listed.filter("m > 2")
    rooted = as_table(three.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")),
                      "minhash-rooted")
    parts = as_table(rooted.groupBy("key", "root").agg(F.count("*").alias("size"), F.sum("n").alias("held")), "minhash-parts")
    most = as_table(parts.groupBy("key").agg(
        F.max(F.struct("size", "root", "held")).alias("most"), F.sum("held").alias("held"), F.count("*").alias("roots")
    ).filter("roots > 1").select("key", "held", F.col("most.root").alias("top"), (F.col("held") - F.col("most.held")).alias("others")),
                    "minhash-most")
    return as_table(
        rooted.join(most, "key").select("key", "cls", "n", "root", "m", (F.col("root") == F.col("top")).alias("big"), "held", "others"),
        "minhash-open",
    )


def _block_links(crowds: DataFrame, heads: DataFrame, sets: DataFrame, plan: Plan, needed: list[int], percent: int) -> DataFrame:
    """Links ``(a, b)`` between the components that meet in large buckets.

    The texts outside the largest component, in blocks of about ``plan.left`` shingles, meet all texts of the
    bucket, in blocks of about ``plan.right``. Each (block, block) is a group of bounded size. Pairs of one component are
    passed over, and so are pairs that share an earlier band; the others are pruned by their codes and
    confirmed on their sets there, and one link for two components leaves the group.
    """
    stay, batch_pairs = _pruner(needed, plan.batch), 1 << 18

    def compare(table):
        import numpy as np
        import pyarrow as pa

        key = table["key"][0].as_py()
        side, root, n = (table[c].to_numpy() for c in ("side", "root", "n"))
        rows = np.arange(len(root))
        code = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(root), -1)
        bands = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(root), -1)
        hashes = table["hashes"].combine_chunks().flatten().to_numpy()
        words = np.unique(hashes, return_inverse=True)[1].ravel()
        starts = np.concatenate([[0], np.cumsum(n)])
        held = np.zeros(len(hashes), bool)
        ours, theirs = rows[side == 0], rows[side == 1]
        found: set[tuple[int, int]] = set()

        def confirm(i: int, others) -> None:
            """Those of ``others`` whose sets are alike enough to that of ``i``."""
            own = words[starts[i] : starts[i + 1]]
            held[own] = True
            sizes = n[others]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(starts[others] - (ends - sizes), sizes)
            common = np.add.reduceat(held[words[at]].astype(np.int64), ends - sizes)
            held[own] = False
            alike = 100 * common >= percent * (n[i] + sizes - common)
            for other in set(root[others[alike]].tolist()):
                found.add((min(int(root[i]), other), max(int(root[i]), other)))

        step = max(1, batch_pairs // max(1, len(theirs)))
        for k in range(0, len(ours), step):
            mine = ours[k : k + step]
            small, large = np.minimum(n[mine][:, None], n[theirs]), np.maximum(n[mine][:, None], n[theirs])
            i, j = np.nonzero((root[mine][:, None] != root[theirs]) & (100 * small >= percent * large))
            i, j = mine[i], theirs[j]
            kept = stay(code, code, i, j)
            i, j = i[kept], j[kept]
            first = (bands[i] == bands[j]).argmax(axis=1)
            kept = bands[i, first] == key
            i, j = i[kept], j[kept]
            cuts = np.flatnonzero(np.diff(i)) + 1
            for some, others in zip(np.split(i, cuts), np.split(j, cuts)):
                # Bounded parts, so that their words fit beside the block.
                for at in range(0, len(others), 512):
                    confirm(int(some[0]), others[at : at + 512])
        links = sorted(found)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    def numbers(count: Column) -> Column:
        return F.sequence(F.lit(0), (F.greatest(count, F.lit(1)) - 1).cast("int"))

    lefts, rights = F.ceil(F.col("others") / plan.left), F.ceil(F.col("held") / plan.right)
    spot = F.xxhash64(F.lit("block"), F.col("cls"))
    own_left, own_right = F.pmod(spot, lefts).cast("int"), F.pmod(spot, rights).cast("int")
    columns = ["key", "i", "j", "side", "cls", "root", "n"]
    as_left = crowds.filter("not big").withColumns({"i": own_left, "side": F.lit(0)}).withColumn("j", F.explode(numbers(rights)))
    as_right = crowds.withColumns({"j": own_right, "side": F.lit(1)}).withColumn("i", F.explode(numbers(lefts)))
    known = as_table(heads.select("cls", "codes", "keys").join(sets, "cls"), "minhash-known")
    met = as_left.select(*columns).union(as_right.select(*columns)).join(known, "cls")
    return met.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def _sets(wanted: DataFrame, texts: DataFrame, classes: DataFrame, shingle_words: int) -> DataFrame:
    """``(cls, hashes)``: full sets of the classes ``wanted``, made again from the texts asked for only."""
    shingles, name = _shingler(shingle_words)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(0)]
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in sets])]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            names = [name(h) for h in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["hi", "lo", "hashes"],
            )

    asked = as_table(classes.join(wanted.distinct(), "cls").select("cls", "hi", "lo", F.col("first_id").alias("id")), "minhash-asked")
    ids, small = narrow(asked.select("id").distinct(), 1)
    ids = ids if small else ids.hint("shuffle_hash")
    found = map_texts(texts.join(ids, "id", "left_semi").select("text"), run, "hi bigint, lo bigint, hashes array<bigint>")
    return as_table(found.dropDuplicates(["hi", "lo"]).join(asked.drop("id"), ["hi", "lo"]).select("cls", "hashes"), "minhash-sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls")))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                    min_percent: int = MIN_PERCENT, plan: Plan = Plan()) -> DataFrame:
    """One row per input row: ``(doc_id, n_shingles, component_id, kept)``.

    ``component_id`` is the smallest id among the documents linked by chains of texts whose sets of distinct
    shingles have a Jaccard similarity of ``min_percent`` or more, confirmed on full sets. Words are runs of other
    characters than U+0020 and U+0009 to U+000D after lower-casing A-Z; a text of fewer words is one shingle.
    Texts without words, and null texts, have an empty set and are linked with nothing. Null ids are no
    component's name unless it has no other. Rows that repeat an id are rows of their own. Other columns are ignored; an
    empty table gives no rows.

    Texts of one set are one class. Classes that share a band are candidates. In a first round each member of a
    bucket meets its leader; a bucket that the links of that round do not tie together is then compared
    whole, except inside its components, so no bucket is cut short and no group of copies is paired out.
    """
    if not 1 <= min_percent <= 100:
        raise ValueError("min_percent must be 1 to 100")
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST_ID)).alias("id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )
    signer = _signer(shingle_words, plan.bands, plan.rows)
    signed = map_texts(
        texts.select("id", "text"), signer, "id bigint, n bigint, hi bigint, lo bigint, keys array<bigint>, codes binary"
    )
    scanned = as_table(signed.withColumn("row", F.monotonically_increasing_id()), "minhash-scan")
    worded = scanned.filter("n > 0")
    classes = as_table(worded.groupBy("hi", "lo").agg(F.min("id").alias("first_id"), F.min("row").alias("cls")), "minhash-classes")
    copies = worded.select("hi", "lo", "row").join(classes.select("hi", "lo", "cls"), ["hi", "lo"]).filter("row <> cls")
    heads = drop_ids(worded, as_table(copies.select("row"), "minhash-copies"), "row").withColumnRenamed("row", "cls")
    heads = as_table(heads.select("cls", "n", "codes", "keys"), "minhash-heads")
    codes = heads.select("cls", "codes")

    postings = heads.select("cls", "n", F.explode("keys").alias("key"))
    sizes = as_table(postings.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "minhash-sizes")
    side, _ = narrow(sizes, 2)
    listed = as_table(postings.join(side, "key"), "minhash-listed")
    needed = least_matches(min_percent, plan.bands * plan.rows, plan.batch, plan.miss)

    stars = as_table(_prune(star_pairs(listed, min_percent), codes, needed, plan.batch), "minhash-stars")
    first = as_table(_confirmed(stars, _sets(_ends(stars), texts, classes, shingle_words), min_percent), "minhash-links")

    opened = open_buckets(listed, components(first))
    short = opened.filter(F.col("m") <= plan.list_rows).select("key", "cls", "n", "root")
    crowds = opened.filter(F.col("m") > plan.list_rows)
    met = (
        short.select("key", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
        .join(short.select("key", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb")), "key")
        .filter("a < b and ra <> rb").filter(_sizes_allow(F.col("na"), F.col("nb"), min_percent)).select("a", "b").distinct()
    )
    pairs = as_table(_prune(met, codes, needed, plan.batch), "minhash-pairs")
    sets = _sets(_ends(pairs).union(crowds.select("cls")), texts, classes, shingle_words)
    blocks = _block_links(crowds, heads, sets, plan, needed, min_percent)
    second = as_table(_confirmed(pairs, sets, min_percent).union(blocks), "minhash-links")

    linked = components(first.union(second))
    named = as_table(
        classes.join(linked.withColumnRenamed("node", "cls"), "cls", "left").select("hi", "lo", "first_id", F.coalesce("root", "cls").alias("root")),
        "minhash-named",
    )
    # Written, so that the join deals out anew and splits a component of very many texts.
    roots = as_table(named.groupBy("root").agg(F.min("first_id").alias("component")), "minhash-roots")
    members = as_table(named.join(roots, "root").select("hi", "lo", "component"), "minhash-members")
    told = worded.select("id", "n", "hi", "lo").join(members, ["hi", "lo"]).select("id", "n", "component")
    alone = scanned.filter("n = 0").select("id", "n", F.col("id").alias("component"))
    own, component = (F.nullif(F.col(c), F.lit(_LAST_ID)) for c in ("id", "component"))
    return told.union(alone).select(
        own.alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), own.eqNullSafe(component).alias("kept")
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                        min_percent: int = MIN_PERCENT) -> DataFrame:
    """``docs`` with the document of the smallest id of each component; all columns stay.

    Rows that repeat an id share one verdict, and so do all rows without one: they go if one of them does.
    """
    found = near_duplicates(docs, id_col, text_col, shingle_words, min_percent)
    return drop_ids(docs, as_table(found.filter("not kept").select(id_col), "minhash-losers"), id_col)

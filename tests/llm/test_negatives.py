import math
import random

import pytest
from pyspark.sql import functions as F

from fieldpulse.llm import negatives
from fieldpulse.llm.negatives import Window, hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_definition(rows, anchor_step, window=Window(), scale=256):
    taken = {}
    for number, vec, label in rows:
        if number is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        row = (label, [math.floor(scale * x) for x in vec])
        taken[number] = min(row, taken.get(number, row))
    out = []
    for a, (label, vec) in taken.items():
        if a % anchor_step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, v)), n, other) for n, (other, v) in taken.items() if n != a)
        for minus, p, _ in [s for s in scored if s[2] == label][: window.positives]:
            fits = [(n, -s) for s, n, other in scored if other != label and window.low * -minus <= 100 * -s <= window.high * -minus]
            out += [(a, p, rank, n, -minus, s) for rank, (n, s) in enumerate(fits[: window.negatives], 1)]
    return sorted(out)


def as_floats(rows):
    """The rows as Spark holds them, with 32-bit components."""
    import numpy as np

    return [(n, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for n, v, label in rows]


def some_rows(rng, count=400, dim=6, labels=4):
    rows = [(n, [rng.gauss(0.1, 1) for _ in range(dim)], rng.randrange(labels)) for n in range(1, count + 1)]
    # Ties, a vector of a third of the rows, vectors without length, short ones, broken ones and repeats.
    rows += [(1000 + n, [0.5] * dim, n % labels) for n in range(count // 2)]
    rows += [(5000 + 10 * n, [0.0] * dim, n % labels) for n in range(12)]
    rows += [(6000, [], 1), (6010, [1.0, 2.0], 1), (6020, None, 1), (6030, [1.0] * dim, None), (6040, [None] + [1.0] * (dim - 1), 1),
             (6050, [float("nan")] * dim, 1), (6060, [float("inf")] + [0.0] * (dim - 1), 1), (None, [1.0] * dim, 1),
             (20, [1.0] * dim, 2), (20, [1.0] * dim, 2), (30, [-1.0] * dim, 0), (-40, [0.25] * dim, 3)]
    return as_floats(rows)


@pytest.mark.parametrize(("block_bytes", "window"), [(16 << 20, Window()), (3_000, Window(2, 7, 0, 99)), (1, Window(30, 1, 80, 90))])
def test_rows_match_brute_force_whatever_the_blocks(spark, block_bytes, window):
    rows = some_rows(random.Random(4))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "anchor", "score", "same", "vec", "row")})
    # One anchor in a block is slow; fewer anchors then.
    step = 10 if block_bytes > 1 else 500
    want = by_definition(rows, step, window)
    got = hard_negatives(df.repartition(7), F.col("id") % step == 0, window=window, block_bytes=block_bytes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == want
    assert any(w[4] == w[5] == 0 for w in want) or window.positives != 5


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(5)
    rows = as_floats([(n, [rng.uniform(1, 2) * 2.0**19 for _ in range(3)], n % 3) for n in range(60)])
    df = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives(df, F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == by_definition(rows, 10) != []


def test_a_part_keeps_the_first_of_many_ties(spark):
    rows = as_floats([(n, [1.0, 0.0], 1) for n in range(0, 3000)] + [(3000 + n, [0.75, 0.0], 2) for n in range(3000)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = hard_negatives(df, F.col("id") == 1500).collect()
    assert {r["positive_id"] for r in got} == {0, 1, 2, 3, 4}
    assert sorted({(r["rank"], r["negative_id"]) for r in got}) == [(1, 3000), (2, 3001), (3, 3002)]


def test_no_rows_no_anchors_and_bad_windows(spark):
    df = spark.createDataFrame(some_rows(random.Random(6), 50), SCHEMA)
    assert hard_negatives(df.filter("false"), F.lit(True)).count() == 0
    assert hard_negatives(df, F.lit(False)).count() == 0
    for bad in ((0, 3, 50, 95), (5, 0, 50, 95), (5, 3, 95, 50), (5, 3, 50, 100)):
        with pytest.raises(ValueError):
            Window(*bad)


def test_keys_sort_by_anchor_descending_score_and_id():
    pack, unpack, _ = negatives._packer()
    rng = random.Random(7)
    rows = [tuple(rng.choice((-1, 1)) * rng.getrandbits(rng.choice((3, 62))) for _ in range(3)) for _ in range(2_000)]
    rows += [(-(1 << 63), -(1 << 63), -(1 << 63)), ((1 << 63) - 1,) * 3]
    assert [unpack(k) for k in sorted(pack(*r) for r in rows)] == sorted(rows, key=lambda r: (r[0], -r[1], r[2]))


def test_the_stream_holds_no_anchor():
    """Rows are taken one by one, and negatives leave as soon as they are read."""
    pack, unpack, _ = negatives._packer()
    taken = []

    def rows():
        yield pack(1, 1000, 5), True
        for n in range(1_000):
            taken.append(n)
            yield pack(1, 900 - n, 10 + n), False

    out = negatives._streamer(Window(), unpack)(rows())
    assert [next(out)[3] for _ in range(3)] == [10, 11, 12] and len(taken) <= 3

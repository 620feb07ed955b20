import random
import zlib

import numpy as np
import pytest
from llm_fixtures import awkward, no_rows, words
from pyspark.sql import functions as F

from fieldpulse.llm.quality import FEATURES, RIDGE, SEED, STATISTICS, _pool, quality_scores, statistics, without_rejected

LABELS = "doc_id bigint, quality int, id string, score string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for n in range(1000, 1600):
        good = n % 4 != 0
        text = ". ".join(words(rng, 9, 10_000).capitalize() for _ in range(6)) if good else " ".join([words(rng, 1)] * 60) + "!!"
        docs.append((n, text, "en" if good else "fr"))
        labels.append((n, int(good), "x", "y"))
    rows, df = awkward(spark, docs)
    return rows, df, spark.createDataFrame([*labels, (None, 1, "x", "y"), (1000, None, "x", "y"), (1001, 7, "x", "y")], LABELS)


def test_held_out_documents_are_told_apart(tables):
    rows, df, labels = tables
    got = quality_scores(df, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    for r in got.collect():
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = got.filter("held_out and doc_id >= 1000").collect()
    assert len(held) > 80 and all(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held)


def test_labels_of_held_out_rows_and_other_columns_play_no_part(tables):
    _, df, labels = tables
    turned = labels.withColumn("quality", F.expr("if(pmod(crc32(cast(doc_id as string)), 5) = 0, 1 - quality, quality)"))
    other = df.withColumn("lang", F.lit("zz")).withColumn("score", F.lit(9))
    first = {r["doc_id"]: r["score"] for r in quality_scores(df, labels).collect()}
    again = {r["doc_id"]: r["score"] for r in quality_scores(other, turned).collect()}
    assert first.keys() == again.keys() and all(abs(first[k] - again[k]) < 1e-6 for k in first)


def test_without_labels_and_without_documents(tables):
    _, df, labels = tables
    assert {r["score"] for r in quality_scores(df, no_rows(labels)).collect()} == {0.5}
    assert quality_scores(no_rows(df), labels).count() == 0
    kept = without_rejected(df, labels)
    assert kept.columns == df.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert {n for n in range(1000, 1600) if n % 4} <= left and len({n for n in range(1000, 1600, 4)} & left) < 5


def test_isotonic_fit():
    knots, levels = _pool([(0.0, 1, 1), (1.0, 1, 0), (2.0, 2, 1), (3.0, 1, 1)])
    assert levels == sorted(levels) and levels == [0.5, 1.0] and knots == [1.25, 3.0]


def part(id_):
    return zlib.crc32(str(id_).encode()) % 5


def monotone(n, y):
    """Isotonic levels by their definition: the largest over all starts of the smallest mean over all ends."""
    def mean(j, k):
        return y[j : k + 1].sum() / n[j : k + 1].sum()

    return [max(min(mean(j, k) for k in range(i, len(n))) for j in range(i + 1)) for i in range(len(n))]


def plain_scores(x, train, calibrate):
    """Kernel features, ridge and calibration on whole matrices; both sets are ``(rows, labels)``."""
    both = np.vstack([train[0], calibrate[0]])
    mean, spread = both.mean(0), both.std(0)
    spread[spread < 1e-9] = 1
    rng = np.random.default_rng(SEED)
    frequencies = rng.standard_normal((both.shape[1], FEATURES)) / np.sqrt(both.shape[1])
    shift = rng.uniform(0, 2 * np.pi, FEATURES)

    def phi(v):
        waves = np.sqrt(2 / FEATURES) * np.cos(np.clip((v - mean) / spread, -6, 6) @ frequencies + shift)
        return np.column_stack([waves, np.ones(len(v))])

    # Ridge as least squares with rows of its own; the constant is not held back.
    held = np.sqrt(RIDGE * len(train[0])) * np.eye(FEATURES, FEATURES + 1)
    weights = np.linalg.lstsq(np.vstack([phi(train[0]), held]), np.r_[train[1], np.zeros(FEATURES)], rcond=None)[0]
    at = np.clip(phi(calibrate[0]) @ weights, -0.5, 1.5)
    bins = np.floor((at + 0.5) / (2 / 2_000))
    names = np.unique(bins)
    n = np.array([(bins == b).sum() for b in names], float)
    y = np.array([calibrate[1][bins == b].sum() for b in names], float)
    middle = np.array([at[bins == b].mean() for b in names])
    levels = np.array(monotone(n, y))
    steps = np.unique(levels)
    knots = [np.average(middle[levels == v], weights=n[levels == v]) for v in steps]
    return np.interp(phi(x) @ weights, knots, steps)


def test_scores_match_a_plain_fit(tables):
    _, df, labels = tables
    rows = [(r["id"], np.array(r["x"], float)) for r in statistics(df).collect()]
    known = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] in (0, 1) and r["doc_id"] is not None]
    pairs = [(i, x, y) for i, x in rows for j, y in known if i == j and part(i)]
    sets = [[(x, y) for i, x, y in pairs if (part(i) == 4) == last] for last in (False, True)]
    train, calibrate = ((np.array([x for x, _ in s]), np.array([y for _, y in s], float)) for s in sets)
    want = plain_scores(np.array([x for _, x in rows]), train, calibrate)
    got = sorted((str(r["doc_id"]), r["score"]) for r in quality_scores(df, labels).collect())
    plain = sorted((str(i), s) for (i, _), s in zip(rows, want, strict=True))
    assert [d for d, _ in got] == [d for d, _ in plain]
    worst = max((abs(a - b), d, a, b) for (d, a), (_, b) in zip(got, plain, strict=True))
    assert worst[0] < 1e-5, worst


def test_held_out_documents_rank_by_quality(tables):
    _, df, labels = tables
    held = [(r["score"], r["doc_id"] % 4 != 0) for r in quality_scores(df, labels).filter("held_out and doc_id >= 1000").collect()]
    good, bad = ([s for s, y in held if y == kind] for kind in (True, False))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad) > 0.99


def test_statistics_of_plain_texts(spark):
    texts = {1: "One two, two two.", 2: "", 3: "a|b\n12 É"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["id"]: dict(zip(STATISTICS, r["x"], strict=True)) for r in statistics(rows).collect()}
    one, three = got[1], got[3]
    assert set(got[2].values()) == {0.0}
    want = {"word_mean": 14 / 4, "upper": 1 / 12, "marks": 0, "stops": 2 / 17, "distinct": 4 / 4, "repeats": 0, "ended": 2 / 4, "capitalised": 1 / 4}
    assert all(abs(one[k] - v) < 1e-6 for k, v in want.items())
    assert abs(three["bars"] - 1 / 9) < 1e-6 and abs(three["digits"] - 2 / 9) < 1e-6 and abs(three["beyond_ascii"] - 2 / 9) < 1e-6
